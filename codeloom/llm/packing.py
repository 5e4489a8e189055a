"""Best-fit packing of documents into sequences of fixed capacity, by a tree of residual merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import drop, save


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, items being taken in the order given; each goes to the open bin that it leaves least room in.

    Bins are stacked by their room, and the rooms in use are the bits of one integer, so an item costs a shift and a lowest bit.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins, out = 0, 0, np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        if m := used >> s:
            room = s + (m & -m).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        if room > s:
            rooms[room - s].append(b)
            used |= 1 << (room - s)
    return out


def _packer(level: int, capacity: int, nearly: int):
    """Packs the rows of one part, that have the same bin together (at level 0 each by itself); nearly full bins are marked done."""

    def pack(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t
        if level == 0:
            t = t.take(pc.sort_indices(t, sort_keys=[("length", "descending"), ("id", "ascending"), ("start", "ascending")]))
            size = t["length"].to_numpy()
            row_bin = best_fit(size, capacity)
        else:
            labels, inverse = np.unique(t["bin"].to_numpy(), return_inverse=True)
            size = np.bincount(inverse, t["length"].to_numpy()).astype(np.int64)
            order = np.lexsort((labels, -size))
            of_label = np.empty(len(labels), np.int64)
            of_label[order] = best_fit(size[order], capacity)
            row_bin = of_label[inverse]
        full = np.bincount(row_bin, t["length"].to_numpy()).astype(np.int64)
        part = t["part"][0].as_py()
        t = t.set_column(t.schema.get_field_index("bin"), t.schema.field("bin"), pa.array((level << 56 | part << 32) + row_bin, pa.int64()))
        t = t.set_column(t.schema.get_field_index("filled"), t.schema.field("filled"), pa.array(full[row_bin], pa.int64()))
        return t.set_column(t.schema.get_field_index("done"), t.schema.field("done"), pa.array(full[row_bin] >= nearly))

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, length: Column | None = None, nearly_full: float = 0.98, items_per_part: int = 50_000, fan_in: int = 8) -> DataFrame:
    """Rows (bin_id, slot, doc_id, start, length): which words of which document stand where in which sequence.

    Lengths are words (runs without white space) unless another column is given. A document longer than capacity gives pieces of
    capacity and a rest, so its whole text is packed. Items are spread over parts by hash and each part is packed best-fit, longest
    first; bins filled to nearly_full are final. The underfull bins then go as items, up to fan_in parts together and no more than about
    items_per_part bins to a task, through best-fit rounds until one part is left, or parts get no fewer: then almost no bins can be
    merged, and those left are final. Before each round a bin leaves that could take not even the smallest bin left anywhere: nothing
    could be added to it. Rounds carry bins, not items; items are joined with the bin that theirs went into at the end.

    Documents without words (null and empty texts too) take no place and have no row. Repeated rows are packed as often as they
    occur. A null id is kept. Ties go by id, then start. The result has id_col as its name for the id; other columns are ignored.
    """
    n = F.coalesce(length if length is not None else word_count(F.col(text_col)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), n.alias("n")).where("n > 0")
    items = save(
        sized.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))).alias("start"), "n").select(
            "id", "start", F.least(F.lit(capacity), F.col("n") - F.col("start")).cast("long").alias("length")
        ),
        "items",
    )
    parts = max(1, -(-items.count() // items_per_part))
    marks = [F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("filled"), F.lit(False).alias("done")]
    state = items.select(F.pmod(F.xxhash64("id", "start"), F.lit(parts)).cast("long").alias("part"), "id", "start", "length", *marks)
    level, tables, nearly = 0, [], int(np.ceil(nearly_full * capacity))
    went = None  # (first, bin): of a bin of level 0 that was not final there, the final one
    while True:
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in state.schema])
        packed = save(state.groupBy("part").applyInArrow(_packer(level, capacity, nearly), schema), f"packed{level}")
        if level:
            drop(tables[-1]) if level > 1 else None
        else:
            drop(items)
        tables.append(packed)
        smallest = packed.where("not done").agg(F.min("filled")).first()[0]
        closed = F.col("done") | (F.col("filled") + F.lit(smallest if smallest is not None else capacity + 1) > capacity)
        left = packed.where(~closed).agg(F.count_distinct("bin")).first()[0] if parts > 1 else 0
        fewer = max(-(-parts // fan_in), -(-left // items_per_part))
        last = parts == 1 or left == 0 or fewer >= parts
        if last:
            closed = F.lit(True)
        if level == 0:
            finished, open_rows = packed.where(closed), packed.where(~closed)
            state = open_rows.groupBy("part", "bin").agg(F.sum("length").alias("length")).select("part", F.col("bin").alias("first"), "length", "bin")
        else:
            final = save(packed.where(closed).select("first", "bin"), "went")
            went = final if went is None else went.unionByName(final)
            state = packed.where(~closed).select("part", "first", "length", "bin")
        if last:
            break
        state = state.withColumn("part", F.floor(F.col("part") * fewer / parts).cast("long")).select("part", "first", "length", "bin", *marks[1:])
        parts, level = fewer, level + 1
    rows = finished.select("id", "start", "length", "bin")
    if went is not None:
        rows = rows.unionByName(open_rows.select("id", "start", "length", F.col("bin").alias("first")).join(went, "first").select("id", "start", "length", "bin"))
        if level:
            drop(packed)
    by = Window.partitionBy("bin").orderBy(F.col("length").desc(), F.col("id").asc_nulls_first(), "start")
    return rows.select(F.col("bin").alias("bin_id"), F.row_number().over(by).cast("long").alias("slot"), F.col("id").alias(id_col), "start", "length")
