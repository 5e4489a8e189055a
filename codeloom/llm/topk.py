"""Exact nearest neighbours of a set of queries among all vectors, by multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.llm.common import drop, save

COARSEST = 4
BLOCK_BYTES = 4 << 20  # of vectors as doubles
SALT = 16
PROBES = 16  # times k: pairs of a query that are computed ahead of others, for a limit


def levels_of(dims: int) -> list[int]:
    """Numbers of segments, coarse to fine: 4, 16, 64 and so on, and last the segments of two."""
    out, s = [], COARSEST
    while s < dims / 2:
        out.append(s)
        s *= 4
    return [*out, max(1, dims // 2)]


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of each row, times the root of the segment's length: the distance between two rows of
    these is never more than that of the vectors, since a segment's covariance is at most the product of its deviations."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(edges, edges[1:])]
    return np.concatenate([np.stack([p.mean(1) * np.sqrt(p.shape[1]) for p in parts], 1), np.stack([p.std(1) * np.sqrt(p.shape[1]) for p in parts], 1)], 1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    d -= 2 * (a @ b.T)
    return d


class Block:
    """Vectors with their statistics at each level."""

    def __init__(self, x: np.ndarray, ids: list):
        self.x, self.ids = x, ids
        self.levels = [segment_statistics(x, s) for s in levels_of(x.shape[1])]
        self.norm = float((x * x).sum(1).max(initial=0))


def _exact(x: np.ndarray, d: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (x[i], d[j]), i in order, summed up from differences."""
    out, ends = np.empty(len(i)), np.searchsorted(i, np.arange(len(x) + 1))
    for r, (b, e) in enumerate(zip(ends[:-1], ends[1:])):
        if e > b:
            gap = d[j[b:e]] - x[r]
            out[b:e] = np.einsum("ij,ij->i", gap, gap)
    return out


def nearest(q: Block, d: Block, limit: np.ndarray, k: int, at_once: int = 256, tally: np.ndarray | None = None):
    """(query, neighbour, squared distance) of up to k neighbours in d of each row of q, none beyond limit, ties by place in d.

    Each pair goes through the bounds of the levels, coarse to fine, until one rules it out; those that all levels leave get their exact
    distance. All have room for rounding. The pairs that look nearest are computed first, and the k-th of their distances is a limit
    for the others. Rows with the id of the query are none of its neighbours. tally: adds up the pairs that came in, and that each level left.
    """
    out, slack, place = [], 1e-9 * (q.norm + d.norm + 1), {}
    for j, name in enumerate(d.ids):
        place.setdefault(name, []).append(j)
    for b in range(0, len(q.x), at_once):
        x, most = q.x[b : b + at_once], limit[b : b + at_once].copy()
        near = np.ones((len(x), len(d.x)), bool)
        for r, name in enumerate(q.ids[b : b + at_once]):
            near[r, place.get(name, [])] = False
        left = [near.sum()]
        pairs = None  # of the pairs left, once they are few
        for level, t in enumerate(d.levels):
            s = q.levels[level][b : b + at_once]
            if pairs is None:
                bound = _squares(s, t)
                np.copyto(bound, np.inf, where=~near)
                if len(d.x) > k and (level + 1 == len(d.levels) or np.isposinf(most).any()):
                    some = min(PROBES * k, len(d.x))
                    like = np.argpartition(bound, some - 1, axis=1)[:, :some]
                    first = _exact(x, d.x, np.repeat(np.arange(len(x)), some), like.ravel()).reshape(like.shape)
                    first[np.isinf(np.take_along_axis(bound, like, 1))] = np.inf
                    most = np.minimum(most, np.partition(first, k - 1, axis=1)[:, k - 1] + slack)
                near = bound <= np.minimum(most, np.finfo(float).max)[:, None] + slack
                if near.mean() < 0.1:
                    pairs = np.nonzero(near)
            else:
                i, j = pairs
                keep = _exact(s, t, i, j) <= most[i] + slack
                pairs = i[keep], j[keep]
            left.append(near.sum() if pairs is None else len(pairs[0]))
        if tally is not None:
            tally += left
        i, j = np.nonzero(near) if pairs is None else pairs
        exact = _exact(x, d.x, i, j)
        keep = exact <= limit[b + i]
        i, j, exact = i[keep], j[keep], exact[keep]
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[top] + b, j[top], exact[top]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _rows(v: pa.Array, dims: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _place(dims: int):
    @F.arrow_udf("long")
    def code(v: pa.Array) -> pa.Array:
        """A code that is near for vectors of like shape: the bits of their coarse statistics, interleaved."""
        x = _rows(v, dims).astype(np.float64)
        s = segment_statistics(x, COARSEST)
        s = s / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        level = np.clip(np.floor(s * 16) + 16, 0, 31).astype(np.int64)
        out = np.zeros(len(x), np.int64)
        for bit in (4, 3, 2, 1, 0):
            for c in range(level.shape[1]):
                out = out << 1 | (level[:, c] >> bit & 1)
        return pa.array(out)

    return code


def _box(x: np.ndarray) -> tuple[list[float], list[float]]:
    s = segment_statistics(x.astype(np.float64), COARSEST)
    return (s.min(0).tolist(), s.max(0).tolist()) if len(s) else ([], [])


def _packer(dims: int, per_block: int, group: int, schema: pa.Schema):
    """Makes blocks of up to per_block rows of a partition, data and queries apart, each in the order of ids (null last)."""

    def block(t: pa.Table, nth: int) -> pa.RecordBatch:
        at = TaskContext.get().partitionId()
        row = {"block": (dims << 32) + (at << 12) + nth, "dims": dims, "grp": (dims << 32) + at // group}
        for kind, names in ((False, ("ids", "vectors", "low", "high")), (True, ("query_ids", "queries", "query_low", "query_high"))):
            some = t.filter(pa.compute.equal(t["query"], kind)).combine_chunks()
            ids, x = some["id"].to_pylist(), _rows(some["v"].combine_chunks(), dims)
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, x[i].tolist()))
            row |= dict(zip(names, ([ids[i] for i in order], np.ascontiguousarray(x[order]).tobytes(), *_box(x))))
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, nth = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, per_block - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == per_block:
                    yield block(pa.Table.from_batches(held), nth)
                    held, n, nth = [], 0, nth + 1
        if n:
            yield block(pa.Table.from_batches(held), nth)

    return run


def _each(t) -> Iterator[dict]:
    """Rows, one at a time."""
    for r in range(t.num_rows):
        yield t.slice(r, 1).to_pylist()[0]


def _vectors(raw: bytes, dims: int, kind) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, dims).astype(np.float64)


def _own(k: int, kind, schema: pa.Schema):
    """Queries against the data of their own block: what is found, and the limit that it sets for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _each(batch):
                q, d = Block(_vectors(r["queries"], r["dims"], kind), r["query_ids"]), Block(_vectors(r["vectors"], r["dims"], kind), r["ids"])
                i, j, s = nearest(q, d, np.full(len(q.x), np.inf), k)
                limit = np.full(len(q.x), np.inf)
                full = np.flatnonzero(np.bincount(i, minlength=len(q.x)) == k)
                limit[full] = np.maximum.reduceat(s, np.searchsorted(i, full)) if len(full) else limit[full]
                made = {c: r[c] for c in ("block", "dims", "grp", "query_ids", "queries", "query_low", "query_high")} | {"limits": limit.tobytes(), "most": float(limit.max(initial=0))}
                yield pa.RecordBatch.from_pylist([made | {"found": [{"row": a, "of": r["block"], "near": b, "neighbour": d.ids[b], "square": c} for a, b, c in zip(i.tolist(), j.tolist(), s.tolist())]}], schema=schema)

    return run


def _others(k: int, kind, schema: pa.Schema):
    """The queries of a group of blocks against some blocks of data; limits tighten from block to block."""

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out = []
        own = queries.sort_by("block").to_pylist()
        if own and data.num_rows:
            dims, at = own[0]["dims"], np.cumsum([0, *(len(r["query_ids"]) for r in own)])
            q = Block(np.concatenate([_vectors(r["queries"], dims, kind) for r in own]), [i for r in own for i in r["query_ids"]])
            limit = np.concatenate([np.frombuffer(r["limits"], np.float64) for r in own])
            blocks = np.repeat(np.arange(len(own)), np.diff(at))
            best, names = np.full((len(q.x), k), np.inf), [r["block"] for r in own]
            for r in _each(data.sort_by("other")):
                d = Block(_vectors(r["vectors"], dims, kind), r["ids"])
                mine = blocks != (names.index(r["other"]) if r["other"] in names else -1)  # done already
                i, j, s = nearest(q, d, np.where(mine, limit, -np.inf), k)
                found = np.full((len(q.x), k), np.inf)
                found[i, np.arange(len(i)) - np.searchsorted(i, i)] = s
                best = np.sort(np.concatenate([best, found], 1), axis=1)[:, :k]
                limit = np.minimum(limit, best[:, -1])
                out += zip(i.tolist(), [r["other"]] * len(i), j.tolist(), [d.ids[b] for b in j.tolist()], s.tolist())
            out = [(own[blocks[i]]["block"], i - at[blocks[i]], q.ids[i], *x) for i, *x in out if x[-1] <= limit[i]]
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(schema), schema)], schema=schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", per_block: int | None = None) -> DataFrame:
    """Rows (id, rank, neighbour, distance): the k nearest rows of vectors of every row of queries by Euclidean distance, exactly.

    Data and queries of like coarse statistics share a block of BLOCK_BYTES (per_block rows, if given). Each block's queries are first
    searched in its own data, which gives them limits; then those of a group of blocks meet the other blocks whose boxes of coarse
    statistics come within their limits. Inside, bounds from segment means and deviations rule pairs out, level by level from coarse
    to fine, and the exact distance is computed for what is left. What bounds don't rule out is compared, so the cost is
    queries times vectors at worst, as that of exact search is. Without queries, all rows of vectors are queries.

    Ties go to the lower neighbour id (null last). Rows of the same id as the query (null counts as an id) are not its neighbours; equal
    rows of other ids are. Repeated queries give repeated rows. Vectors that are null, empty or hold null, NaN or infinity have no rows
    and are nobody's neighbour; vectors of other lengths are searched apart. With fewer than k others, there are fewer rows.
    Distances are rounded to 6 places. Other columns are not used.
    """
    spark = vectors.sparkSession
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    narrow = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = np.float32 if narrow else np.float64

    def clean(df: DataFrame, query: bool) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("v"), F.lit(query).alias("query")).where(ok)

    rows = clean(vectors, False).unionByName(clean(vectors if queries is None else queries, True)).withColumn("dims", F.size("v"))
    id_type, pa_id = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    floats = pa.list_(pa.float64())
    block_kind = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("grp", pa.int64()), ("ids", pa.list_(pa_id)), ("vectors", pa.binary()), ("low", floats), ("high", floats), ("query_ids", pa.list_(pa_id)), ("queries", pa.binary()), ("query_low", floats), ("query_high", floats)])
    made = None
    counts = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("query").alias("queries")).collect()  # a row for each length of vectors
    for r in sorted(counts, key=lambda r: r["dims"]):
        dims, per = r["dims"], per_block or max(64, BLOCK_BYTES // (8 * r["dims"]))
        n = -(-r["n"] // per)
        group = max(1, per * n // max(1, r["queries"]))
        placed = rows.where(F.col("dims") == dims).withColumn("code", _place(dims)("v")).repartitionByRange(n, "code", F.xxhash64("id"))
        part = placed.select("id", "v", "query").mapInArrow(_packer(dims, per, group, block_kind), f"block bigint, dims int, grp bigint, ids array<{id_type}>, vectors binary, low array<double>, high array<double>, query_ids array<{id_type}>, queries binary, query_low array<double>, query_high array<double>")
        made = part if made is None else made.unionByName(part)
    if made is None:
        return spark.createDataFrame([], f"{id_col} {id_type}, rank bigint, neighbour {id_type}, distance double")
    blocks = save(made, "blocks")
    hit, pa_hit = f"row: bigint, of: bigint, near: bigint, neighbour: {id_type}, square: double", pa.struct([("row", pa.int64()), ("of", pa.int64()), ("near", pa.int64()), ("neighbour", pa_id), ("square", pa.float64())])
    own_kind = pa.schema([block_kind.field(c) for c in ("block", "dims", "grp", "query_ids", "queries", "query_low", "query_high")] + [pa.field("limits", pa.binary()), pa.field("most", pa.float64()), pa.field("found", pa.list_(pa_hit))])
    own_ddl = f"block bigint, dims int, grp bigint, query_ids array<{id_type}>, queries binary, query_low array<double>, query_high array<double>, limits binary, most double, found array<struct<{hit}>>"
    own = save(blocks.where(F.size("query_ids") > 0).mapInArrow(_own(k, kind, own_kind), own_ddl), "own")

    q = own.select("block", "dims", "grp", "query_low", "query_high", "most", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    d = blocks.where(F.size("ids") > 0).select(F.col("block").alias("other"), "dims", "low", "high", F.pmod("block", F.lit(SALT)).cast("int").alias("salt"))
    gap = F.zip_with(F.zip_with("query_low", "high", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.zip_with("low", "query_high", lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda a, b: F.pow(F.greatest(a, b), 2))
    within = F.aggregate(gap, F.lit(0.0), lambda a, x: a + x) <= F.col("most") * (1 + 1e-9) + 1e-9
    at_once = max(1, min(16, blocks.count() // 32))
    pairs = q.join(d, ["dims", "salt"]).where(within & (F.col("block") != F.col("other"))).select("grp", "other").distinct()
    pairs = save(pairs.withColumn("part", F.floor(F.pmod(F.shiftright("other", 12), F.lit(1 << 20)) / at_once)), "pairs")
    data = pairs.join(blocks.select(F.col("block").alias("other"), "ids", "vectors"), "other").select(F.col("grp").alias("to_grp"), F.col("part").alias("to_part"), "other", "ids", "vectors")
    asking = own.join(pairs.select("grp", "part").distinct(), "grp").select("grp", "part", "block", "dims", "query_ids", "queries", "limits")
    out_kind = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("id", pa_id), *((f.name, f.type) for f in pa_hit if f.name != "row")])
    out_ddl = f"block bigint, row bigint, id {id_type}, of bigint, near bigint, neighbour {id_type}, square double"
    others = save(asking.groupBy("grp", "part").cogroup(data.groupBy("to_grp", "to_part")).applyInArrow(_others(k, kind, out_kind), out_ddl), "others")
    first = save(own.select("block", "query_ids", F.explode("found").alias("f")).select("block", "f.row", F.element_at("query_ids", (F.col("f.row") + 1).cast("int")).alias("id"), "f.of", "f.near", "f.neighbour", "f.square"), "first")
    for x in (blocks, own, pairs):
        drop(x)
    by = Window.partitionBy("block", "row").orderBy("square", F.col("neighbour").asc_nulls_last(), "of", "near")
    ranked = first.unionByName(others).withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(id_col), "rank", "neighbour", F.round(F.sqrt("square"), 6).alias("distance"))


def oracle(k: int = 10, every: int = 20) -> str:
    return f"""
with e as (select vec_id, embedding::double[] as v from embeddings),
p as (select a.vec_id, b.vec_id as neighbour, list_distance(a.v, b.v) as d from e a join e b on a.vec_id <> b.vec_id where a.vec_id % {every} = 0),
r as (select *, row_number() over (partition by vec_id order by d, neighbour) as rank from p)
select vec_id, rank, neighbour, round(d, 6) as distance from r where rank <= {k}"""
