"""I-Match fingerprints: a hash of the terms of a document whose inverse document frequency lies in a band, over several lexicons."""

from __future__ import annotations

import hashlib
import math
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BROADCAST_ENTRIES, row_key

UP, LOW = string.ascii_uppercase, string.ascii_lowercase
KEPT = "b3"  # of the two hex digits that place a term in a random lexicon, those below: 70 %


def terms(text: Column) -> Column:
    """Distinct runs without ASCII white space, ASCII letters in lower case."""
    return F.array_distinct(F.filter(F.split(F.translate(text, UP, LOW), r"[ \t\n\r\f\x0B]+"), lambda x: x != ""))


def _bits(term: bytes, lexicons: int) -> int:
    return 1 | sum((hashlib.md5(b"%d:%b" % (s, term)).hexdigest()[:2] < KEPT) << s for s in range(1, lexicons + 1))


def _prints(words: list[tuple[bytes, int]], lexicons: int) -> dict:
    words.sort()
    out = {"n_terms": len(words)}
    for s in range(lexicons + 1):
        chosen = [w for w, bits in words if bits >> s & 1]
        out[f"fp{s}"] = hashlib.md5(b" ".join(chosen)).hexdigest() if chosen else None
    return out


def i_match(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 2.5, high: float = 6.5, lexicons: int = 4, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Rows (doc_id, n_terms, fp0 .. fpN) for every row of docs.

    A term counts if ln(N / df) lies within low and high, N being the rows with any term and df those with this one. fp0 hashes all
    such terms of the document, sorted; each other one those in a random lexicon of about 70 % of them, which is what lets documents
    that differ in a few terms still share a fingerprint. Documents share one when all its terms agree.

    A fingerprint without terms is null; a null or empty text has n_terms 0 and only nulls. Repeated rows count each. Other columns of
    docs are not used. A document holds a bounded number of terms, so at most (mean terms) * exp(high) terms are in the band however
    large the corpus; up to broadcast_entries of them are broadcast, more go through a join.
    """
    seen = docs.select(terms(F.col(text_col)).alias("t"))
    n = docs.where(F.col(text_col).rlike(r"[^ \t\n\r\f\x0B]")).count()
    band = seen.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") * math.exp(low) <= n) & (F.col("df") * math.exp(high) >= n)).select("term")
    found = [r.term.encode() for r in band.limit(broadcast_entries + 1).toLocalIterator()]
    kind = pa.struct([("n_terms", pa.int64()), *((f"fp{s}", pa.string()) for s in range(lexicons + 1))])
    ddl = "struct<n_terms:bigint," + ",".join(f"fp{s}:string" for s in range(lexicons + 1)) + ">"
    if len(found) <= broadcast_entries:
        held = docs.sparkSession.sparkContext.broadcast({t: _bits(t, lexicons) for t in found})

        @F.arrow_udf(ddl)
        def prints(a: pa.Array) -> pa.Array:
            known = held.value
            return pa.array([_prints([(w, known[w]) for w in set((t or "").encode().lower().split()) if w in known], lexicons) for t in a.to_pylist()], kind)

        out = docs.select(F.col(id_col), prints(F.col(text_col)).alias("p"))
    else:

        @F.arrow_udf(ddl)
        def prints(a: pa.Array) -> pa.Array:
            return pa.array([_prints([(w.encode(), _bits(w.encode(), lexicons)) for w in t or ()], lexicons) for t in a.to_pylist()], kind)

        keyed = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), terms(F.col(text_col)).alias("t"))
        chosen = keyed.dropDuplicates(["key"]).select("key", F.explode("t").alias("term")).join(band, "term").groupBy("key").agg(F.collect_list("term").alias("chosen"))
        out = keyed.select("id", "key").join(chosen, "key", "left").select(F.col("id").alias(id_col), prints("chosen").alias("p"))
    return out.select(id_col, "p.*")


def oracle(low: float = 2.5, high: float = 6.5, lexicons: int = 4) -> str:
    prints = ", ".join(
        f"md5(string_agg(term, ' ' order by term) filter (where {f'''substr(md5('{s}:' || term), 1, 2) < '{KEPT}' ''' if s else 'term is not null'})) as fp{s}" for s in range(lexicons + 1)
    )
    return f"""
with t as (select distinct doc_id, unnest(regexp_split_to_array(translate(text, '{UP}', '{LOW}'), '[ \\t\\n\\r\\f\\x0B]+')) as term from documents),
u as (select * from t where term <> ''), n as (select count(distinct doc_id) as n from u),
band as (select term from u group by term having count(*) * {math.exp(low)!r}::double <= (select n from n) and count(*) * {math.exp(high)!r}::double >= (select n from n)),
c as (select doc_id, term from u join band using (term))
select documents.doc_id, count(term) as n_terms, {prints} from documents left join c using (doc_id) group by documents.doc_id"""
