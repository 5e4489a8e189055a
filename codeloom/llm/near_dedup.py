"""Near-duplicate removal by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import WordHashes, columns, drop, fresh, mix, row_key, save, shingles

SLOTS = 1 << 20  # of the fixed-size filters that are broadcast
BAG = 64
SHORT, SHORT_PICKS = 28, 5  # texts of so many words have sketches of single words too, of so many each


def order_minhash(h: np.ndarray, k: int, picks: int, sketches: int) -> np.ndarray:
    """Sketches of a document of word hashes h, each a hash of the few k-mers that rank lowest, in the order of the text.

    A k-mer is labelled with how many times it has occurred before, so repeats count. A document with fewer k-mers than picks gives
    them all, one shorter than k its whole; one without words gives nothing.
    """
    if not len(h):
        return np.zeros(0, np.uint64)
    g = shingles(h, min(k, len(h)))
    n = len(g)
    order = np.argsort(g, kind="stable")
    s = g[order]
    starts = np.concatenate([[True], s[1:] != s[:-1]])
    with np.errstate(over="ignore"):
        if starts.all():
            x = g
        else:
            at = np.arange(n)
            seen = np.empty(n, np.uint64)
            seen[order] = at - np.maximum.accumulate(np.where(starts, at, 0))
            x = mix(g + seen * np.uint64(0x9E3779B97F4A7C15))
        seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        if n <= picks:
            at = np.broadcast_to(np.arange(n), (sketches, n))
        else:
            rank = x[None, :] * seeds[:, None]
            rank ^= rank >> np.uint64(32)
            at = np.sort(np.argpartition(rank, picks - 1, axis=1)[:, :picks], axis=1)
        out = seeds.copy()
        for j in range(at.shape[1]):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + g[at[:, j]])
    return out


def bag(h: np.ndarray) -> np.ndarray:
    """Counts of a document's words in BAG classes, up to 255 each. Where one document has more of a class than another, words have to
    be edited, so the sum of what either has more bounds the edit distance from below."""
    return np.minimum(np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=BAG), 255).astype(np.uint8)


@F.arrow_udf(T.BooleanType())
def _may_be_close(a: pa.Array, b: pa.Array, bound: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(z.to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16) for z in (a, b))
    d = x - y
    return pa.array(np.maximum(np.maximum(d, 0).sum(1), np.maximum(-d, 0).sum(1)) <= bound.to_numpy())


def _sketched(k: int, picks: int, sketches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, same, sk, bags = [], [], [], []
            for text in batch["text"].to_pylist():
                h = hashes.of((text or "").split())
                n.append(len(h))
                raw = h.tobytes()
                same.append(xxhash.xxh3_128_digest(raw))
                own = order_minhash(h, k, picks, sketches)
                if len(h) <= SHORT:
                    own = np.concatenate([own, order_minhash(h, 1, SHORT_PICKS, sketches)])
                sk.append(own.view(np.int64))
                bags.append(bag(h).tobytes())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], pa.array(n, pa.int32()), pa.array(same, pa.binary()), pa.array(sk, pa.list_(pa.int64())), pa.array(bags, pa.binary())], ["id", "key", "n", "same", "sketch", "bag"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array([hashes.of(t.split()).astype(np.uint32).tobytes() for t in batch["text"].to_pylist()], pa.binary())], ["key", "tokens"])


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], width: np.ndarray) -> np.ndarray:
    """Edit distances, those of up to width[p] exact, others more than width[p]. All pairs go down their bands together."""
    far = 1 << 28
    out = np.full(len(pairs), far, np.int64)
    w = int(width.max())
    la, lb = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    live = np.flatnonzero(np.abs(la - lb) <= width)
    if not len(live):
        return out
    rows = int(la[live].max())
    a = np.full((len(live), rows), -1, np.int32)
    b = np.full((len(live), rows + 2 * w + 1), -2, np.int32)
    for r, p in enumerate(live):
        a[r, : la[p]] = pairs[p][0]
        y = pairs[p][1][: b.shape[1] - w]
        b[r, w : w + len(y)] = y
    offs = np.arange(2 * w + 1, dtype=np.int32)
    d = np.broadcast_to(np.where(offs >= w, offs - w, far), (len(live), 2 * w + 1)).astype(np.int32)
    for i in range(rows + 1):
        if i:
            step = d + (a[:, i - 1, None] != b[:, i - 1 : i + 2 * w])
            np.minimum(step[:, :-1], d[:, 1:] + 1, out=step[:, :-1])
            d = np.minimum.accumulate(step - offs, axis=1) + offs
        ended = la[live] == i
        if ended.any():
            at = live[ended]
            out[at] = d[ended, lb[at] - la[at] + w]
        if ended.any() or i % 32 == 31:
            go = ~ended & (d.min(1) <= width[live])
            if not go.all():
                live, a, b, d = live[go], a[go], b[go], d[go]
                if not len(live):
                    break
    return out


def edit_close(pairs: list[tuple[np.ndarray, np.ndarray]], least: float, cells: int = 400_000) -> np.ndarray:
    """Which pairs of word sequences are alike: edit distance at most (1 - least) of the longer length.

    Common ends are cut off first. A narrow band settles most pairs; the others are aligned in wider and wider bands, up to the bound.
    """
    bound = np.array([math.floor((1 - least) * max(len(a), len(b)) + 1e-9) for a, b in pairs])
    cut = []
    for a, b in pairs:
        m = min(len(a), len(b))
        x = int(np.argmin(np.append(a[:m] == b[:m], False)))
        m -= x
        y = int(np.argmin(np.append((a[len(a) - m :] == b[len(b) - m :])[::-1], False)))
        cut.append(tuple((z[x : len(z) - y] >> np.uint32(1)).astype(np.int32) for z in (a, b)))
    size = np.array([max(len(a), len(b)) for a, b in cut])
    close = size <= bound
    todo, band = np.flatnonzero(~close & (bound > 0)), 12
    while len(todo):
        width = np.minimum(bound, band)
        todo = todo[np.lexsort((size[todo], width[todo]))]
        at = 0
        while at < len(todo):
            end, most = at, 0
            while end < len(todo):
                w, most = int(width[todo[end]]), max(most, int(size[todo[end]]))
                if end > at and (end + 1 - at) * max(2 * w + 1, most // 4) > cells:
                    break
                end += 1
            pick = todo[at:end]
            close[pick] = _banded([cut[p] for p in pick], width[pick]) <= width[pick]
            at = end
        todo, band = todo[~close[todo] & (bound[todo] > band)], 3 * band
    return close


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) for p, q in zip(batch["ta"].to_pylist(), batch["tb"].to_pylist())]
            ok = edit_close(x, least)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(ok)), batch["b"].filter(pa.array(ok))], ["a", "b"])

    return run


def _slot(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SLOTS))


def _slots(keys: DataFrame, c: Column, name: str = "__slot") -> DataFrame:
    """The slots that keys fall in: a filter of at most SLOTS rows whatever the input, so that it can be broadcast."""
    return F.broadcast(keys.select(_slot(c).alias(name)).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of edges (a, b) is connected with.

    Labels take the least of their neighbours' and then the label of their label, until nothing changes. Each round is saved.
    """
    both = save(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        new = save(hooked.join(up, hooked.label == up.up).select("node", F.least("label", "top").alias("label"), (F.least("label", "top") != F.col("was")).alias("moved")), "labels")
        drop(labels)
        labels = new
        if not labels.where("moved").limit(1).count():
            drop(both)
            out = labels.select("node", "label")
            out._saved_at = labels._saved_at
            return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.85, k: int = 3, picks: int = 3, sketches: int = 32) -> DataFrame:
    """Rows (id, key, group, keep) of the documents that have a near-duplicate, exact copies included.

    Documents are near-duplicates if the edit distance of their words is at most (1 - least) of the longer one's length; a group is
    what such pairs connect. Texts that are equal word for word are one node. Nodes that share any Order MinHash sketch are
    candidates; texts of up to SHORT words have as many sketches again over single words, since one edit takes most of their runs. In
    each bucket the least node is compared with all others, which joins most groups with one alignment per node; then
    all pairs of a bucket that are still in different groups are compared too, so the groups are those of all candidate pairs. A pair
    is aligned unless its lengths or counts of words already show it to be too far apart.

    group is the least id of the group; keep marks one row in each, the first by id (null last). Texts without words (null, empty)
    are in no group. Repeated rows are copies. Texts are compared whole. key identifies rows by id and text.
    """
    slim = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")
    id_type = slim.schema["id"].dataType.simpleString()
    made = save(slim.mapInArrow(_sketched(k, picks, sketches), f"id {id_type}, key struct<a:bigint,b:bigint>, n int, same binary, sketch array<bigint>, bag binary").where("n > 0"), "sketched")
    nodes = made.groupBy("same").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    in_bucket = Window.partitionBy("bucket")
    lead = F.min(F.struct("same", "n")).over(in_bucket)
    buckets = save(nodes.select("same", "n", F.explode("sketch").alias("bucket")).select("bucket", "same", "n", lead.alias("lead"), F.count("*").over(in_bucket).alias("members")).where("members > 1"), "buckets")

    def fits(p: str, q: str) -> Column:
        return F.abs(F.col(p) - F.col(q)) <= F.floor((1 - least) * F.greatest(p, q) + 1e-9)

    def may_be_close(pairs: DataFrame) -> DataFrame:
        bound = F.floor((1 - least) * F.greatest("na", "nb") + 1e-9)
        return pairs.where(_may_be_close("bag_a", "bag_b", bound)).select("a", "b").distinct()

    # The words of candidates are read again from one row of each, rather than kept for all documents.
    kept_bags = bags = save(made.select("same", "key", "bag").join(buckets.select("same").distinct(), "same").groupBy("same").agg(F.min(F.struct("key", "bag")).alias("of")).select("same", "of.*"), "bags")
    again = slim.withColumn("__slot", _slot(F.col("key"))).join(_slots(bags, F.col("key")), "__slot", "left_semi").select("key", "text")
    tokens = save(again.mapInArrow(_words, "key struct<a:bigint,b:bigint>, tokens binary").join(bags.select("same", "key"), "key").select("same", "tokens").dropDuplicates(["same"]), "tokens")
    bags = bags.select("same", "bag")

    def close(pairs: DataFrame) -> DataFrame:
        full = pairs.join(tokens.select(F.col("same").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("same").alias("b"), F.col("tokens").alias("tb")), "b")
        return save(full.select("a", "b", "ta", "tb").mapInArrow(_verified(least), "a binary, b binary"), "close")

    star = buckets.where(F.col("same") != F.col("lead.same")).select(F.col("lead.same").alias("a"), F.col("same").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb")).where(fits("na", "nb")).distinct()
    star = save(may_be_close(star.join(bags.toDF("a", "bag_a"), "a").join(bags.toDF("b", "bag_b"), "b")), "star")
    first = close(star)
    labels = components(first)
    placed = buckets.join(labels, buckets.same == labels.node, "left").select("bucket", "same", "n", F.coalesce("label", "same").alias("label"))
    split = placed.withColumn("most", F.max("label").over(in_bucket)).withColumn("few", F.min("label").over(in_bucket)).where("most <> few").select("bucket", "same", "n", "label").join(bags, "same")
    p, q = (split.select("bucket", F.col("same").alias(x), F.col("n").alias("n" + x), F.col("label").alias("label_" + x), F.col("bag").alias("bag_" + x)) for x in "ab")
    rest = may_be_close(p.join(q, "bucket").where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & fits("na", "nb"))).join(star, ["a", "b"], "left_anti")
    second = close(rest)
    earlier, labels = labels, components(first.unionByName(second))
    rows = made.select("id", "key", "same")
    copies = rows.groupBy("same").count().where("count > 1").select("same", F.lit(1).alias("copy"))
    joined = rows.join(copies, "same", "left").join(labels, rows.same == labels.node, "left").where("copy is not null or label is not null").withColumn("label", F.coalesce("label", "same"))
    w = Window.partitionBy("label")
    out = save(joined.select("id", "key", F.min("id").over(w).alias("group"), (F.row_number().over(w.orderBy(F.col("id").asc_nulls_last(), "key")) == 1).alias("keep")), "groups")
    for x in (buckets, tokens, star, first, second, made, kept_bags, earlier, labels):
        drop(x)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Rows (doc_id, group_id, keep) of the documents in groups of near-duplicates; see groups()."""
    return groups(docs, id_col, text_col, **params).select(F.col("id").alias(id_col), F.col("group").alias("group_id"), "keep")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs without all but one row of each group of near-duplicates, its columns as they were, whatever their names.

    Rows pass a fixed-size filter by key first, so only those that may go are shuffled. Of rows equal in id and text one stays.
    """
    found = groups(docs, id_col, text_col, **params)
    marks = save(found.groupBy("key").agg(F.max("keep").alias("keep"), F.count("*").alias("times")).where("not keep or times > 1").select("key", "keep"), "marks")
    drop(found)
    key, slot, keep, nth = fresh(docs, "__key", "__slot", "__keep", "__nth")
    keyed = docs.withColumn(key, row_key(id_col, text_col)).withColumn(slot, _slot(F.col(key)))
    slots = _slots(marks, F.col("key"), slot)
    sure = keyed.join(slots, slot, "left_anti")
    maybe = keyed.join(slots, slot, "left_semi").join(marks.select(F.col("key").alias(key), F.col("keep").alias(keep)), key, "left").where(F.col(keep).isNull() | F.col(keep))
    maybe = maybe.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(slot))).where(F.col(keep).isNull() | (F.col(nth) == 1))
    return sure.select(*columns(docs)).unionByName(maybe.select(*columns(docs)))
