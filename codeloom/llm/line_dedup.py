"""Line dedup: lines that too many documents hold are dropped wherever they stand."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BROADCAST_ENTRIES, columns, fresh, row_key


def normalised(line: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")))


def _hashes(text: Column) -> Column:
    """A hash per line; null for blank lines, which never count."""

    def one(x: Column) -> Column:
        y = normalised(x)
        return F.when(y != "", F.xxhash64(y))

    return F.transform(F.split(text, "\n"), one)


def _in(hot: np.ndarray):
    """Arrow UDF: for each array of hashes, which are in the sorted array hot; null where none is."""

    @F.arrow_udf("array<boolean>")
    def found(a: pa.Array) -> pa.Array:
        values, offsets = a.values, a.offsets.to_numpy()
        v = values.to_numpy(zero_copy_only=False) if not values.null_count else values.fill_null(0).to_numpy(zero_copy_only=False)
        hit = np.isin(v, hot)
        if values.null_count:
            hit &= values.is_valid().to_numpy(zero_copy_only=False)
        sums = np.concatenate([[0], np.cumsum(hit)])
        none = sums[offsets[1:]] == sums[offsets[:-1]]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hit), mask=pa.array(none))

    return found


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 50, broadcast_entries: int = BROADCAST_ENTRIES, copies_count: bool = True) -> DataFrame:
    """docs with text_col rewritten, and n_lines and n_dropped added.

    Lines are split at line feeds, normalised and hashed. A line that more than max_docs distinct documents hold is dropped
    everywhere; the others stay, in their order and unaltered.

    Without copies_count, documents of the same set of normalised lines count as one document, whatever their ids: a line counts as
    common only if that many differing documents hold it, so a text that is merely copied often keeps its lines.

    Null text stays null with 0 lines; empty text has one blank line. Blank lines are neither counted nor dropped. A line that
    repeats within a document counts once; rows with one id are one document, and so are all rows with a null id. A document
    that loses all its lines keeps its row with an empty text. Columns of docs named n_lines or n_dropped, in capitals or not, are
    replaced; other columns stay, whatever their names.

    Only hashes are shuffled. The hashes over the threshold go to executors as a sorted array if there are at most
    broadcast_entries of them, else through a join by row.
    """
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit("\0null")) if copies_count else F.lit(None)
    own = docs.select(doc.alias("d"), F.array_distinct(_hashes(F.col(text_col))).alias("lines"))
    if not copies_count:  # below the explode, so that it is made once a document and not once a line
        own = own.select(F.xxhash64(F.sort_array("lines")).alias("d"), "lines")
    seen = own.select("d", F.explode("lines").alias("h")).where("h is not null")
    hot = seen.groupBy("h").agg(F.count_distinct("d").alias("n")).where(F.col("n") > max_docs).select("h")
    found = [r.h for r in hot.limit(broadcast_entries + 1).toLocalIterator()]
    kept_names, (split, hashes, gone, key, some) = columns(docs, "n_lines", "n_dropped"), fresh(docs, "__lines", "__hashes", "__gone", "__key", "__set")
    wide = docs.select(*kept_names, F.split(F.col(text_col), "\n").alias(split), _hashes(F.col(text_col)).alias(hashes))
    if len(found) <= broadcast_entries:
        wide = wide.withColumn(gone, _in(np.sort(np.array(found, np.int64)))(hashes))
    else:
        keyed = docs.select(row_key(id_col, text_col).alias(key), F.explode(F.array_distinct(_hashes(F.col(text_col)))).alias("h")).where("h is not null")
        per_row = keyed.join(hot, "h").groupBy(key).agg(F.collect_set("h").alias(some))
        wide = wide.withColumn(key, row_key(id_col, text_col)).join(per_row, key, "left").withColumn(gone, F.when(F.col(some).isNotNull(), F.transform(hashes, lambda h: F.coalesce(F.array_contains(some, h), F.lit(False)))))
    kept = F.filter(split, lambda x, i: ~F.element_at(gone, i + 1))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col)
    return wide.select(
        *[text if c.lower() == text_col.lower() else x for c, x in zip([c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], kept_names)],
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(split) - F.size(kept)).cast("long").alias("n_dropped"),
    )


def oracle(max_docs: int = 50) -> str:
    norm = r"lower(trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g')))"
    return f"""
with l as (select doc_id, line, pos, {norm} as norm from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
hot as (select norm from l where norm <> '' group by norm having count(distinct doc_id) > {max_docs}),
k as (select doc_id, count(*) as n_lines, count(hot.norm) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (where hot.norm is null), '') as text from l left join hot using (norm) group by doc_id)
select doc_id, text, n_lines, n_dropped from k"""
