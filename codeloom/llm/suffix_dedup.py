"""Suffix-array dedup: passages that occur more than once, from the BWT and common prefixes of document collections."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import WordHashes, drop, mix, row_key, run_dir, save, shingles

GRAM = 8  # words of an anchor
SLOTS = 1 << 20
SAMPLED, HOT_KEYS = 128, 10_000


class Streams:
    """Sequential files of one collection, under the shared folder. Each is written from front to end, in parts, and read so: the next
    generation of a file is written while the last one is read, and takes its place."""

    def __init__(self, folder: str, chunk: int):
        self.fs, root = fs.FileSystem.from_uri(folder)
        self.path, self.chunk = f"{root}/{uuid.uuid4().hex}", chunk
        self.fs.create_dir(self.path, recursive=True)
        self.kinds: dict[str, np.dtype] = {}
        self.turn: dict[str, int] = {}

    def start(self, name: str, a: np.ndarray) -> None:
        self.kinds[name] = a.dtype
        with self.writer(name) as out:
            self.put(out, a)
        self.over(name)

    def writer(self, name: str):
        return self.fs.open_output_stream(f"{self.path}/{name}.{self.turn.get(name, -1) + 1}", compression=None)

    def put(self, out, a: np.ndarray) -> None:
        out.write(memoryview(np.ascontiguousarray(a)).cast("B"))

    def over(self, name: str) -> None:
        """The generation that was written is the one to read from now on."""
        self.turn[name] = self.turn.get(name, -1) + 1
        if self.turn[name]:
            self.fs.delete_file(f"{self.path}/{name}.{self.turn[name] - 1}")

    def parts(self, name: str) -> Iterator[np.ndarray]:
        kind = self.kinds[name]
        with self.fs.open_input_stream(f"{self.path}/{name}.{self.turn[name]}", compression=None) as f:
            while raw := f.read(self.chunk * kind.itemsize):
                yield np.frombuffer(raw, kind)

    def close(self) -> None:
        self.fs.delete_dir(self.path)


class RangeMin:
    """Minima of ranges of an array, from minima within and over blocks."""

    B = 64

    def __init__(self, a: np.ndarray):
        n = -(-len(a) // self.B) * self.B
        self.a = np.concatenate([a, np.full(n - len(a), np.iinfo(a.dtype).max, a.dtype)])
        blocks = self.a.reshape(-1, self.B)
        self.pre = np.minimum.accumulate(blocks, axis=1).ravel()
        self.suf = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(1)]
        while 2 ** len(self.table) <= len(blocks):
            t, half = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of [first, last], both included."""
        p, q = first // self.B, last // self.B
        out = np.minimum(self.suf[first], self.pre[last])
        gap = q - p - 1
        level = np.zeros(len(first), np.int64)
        wide = gap > 0
        level[wide] = np.frexp(gap[wide].astype(np.float64))[1] - 1
        for k in np.unique(level[wide]):
            at = np.flatnonzero(wide & (level == k))
            out[at] = np.minimum(out[at], np.minimum(self.table[k][p[at] + 1], self.table[k][q[at] - 2**k]))
        if len(same := np.flatnonzero(p == q)):
            offs = np.arange(self.B)
            for part in np.array_split(same, len(same) // 20_000 + 1):
                rows = self.a.reshape(-1, self.B)[p[part]].copy()
                f, e = first[part] - p[part] * self.B, last[part] - p[part] * self.B
                rows[(offs < f[:, None]) | (offs > e[:, None])] = np.iinfo(self.a.dtype).max
                out[part] = rows.min(1)
        return out


def _windows(least: int):
    """A hash for each window of `least` words that holds the context of a segment, and where it begins."""
    side = least - GRAM - (least - GRAM) // 2

    def sums(words: list[bytes], count: np.ndarray, salt: int) -> np.ndarray:
        """Of each row, the sums over its first 0, 1, .. side words."""
        w = np.zeros((len(words), side + 1), np.uint64)
        row = np.repeat(np.arange(len(words)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        w[row, nth + 1] = mix(mix(np.frombuffer(b"".join(words), np.uint32).astype(np.uint64) + np.uint64(1)) + (nth.astype(np.uint64) * np.uint64(2) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15))
        return np.cumsum(w, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts = [np.frombuffer(x, np.uint32)[::-1].tobytes() for x in batch["left"].to_pylist()]
            rights = batch["right"].to_pylist()
            a, b = (np.array([len(x) // 4 for x in z], np.int64) for z in (lefts, rights))
            with np.errstate(over="ignore"):
                left, right = sums(lefts, a, 1), sums(rights, b, 2)
                key, begin = batch["key"].to_numpy().view(np.uint64), batch["begin"].to_numpy()
                for l in range(side + 1):
                    ok = np.flatnonzero((a >= l) & (b >= side - l))
                    window = mix(mix(key[ok] + np.uint64(l)) + left[ok, l] + right[ok, side - l])
                    yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), batch["doc"].take(pa.array(ok)), pa.array((begin[ok] + a[ok] - l).astype(np.int32))], ["window", "doc", "start"])

    return run


def range_minima(parts: Iterator[np.ndarray], chunk: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of the ranges [first, last] of an array that comes in parts of `chunk` entries, read once."""
    out, lows = np.full(len(first), np.iinfo(np.int16).max, np.int16), []
    p, q = first // chunk, last // chunk
    by_first, by_last = np.argsort(p, kind="stable"), np.argsort(q, kind="stable")
    for k, a in enumerate(parts):
        own = by_first[slice(*np.searchsorted(p[by_first], [k, k + 1]))]
        inside, across = own[q[own] == k], own[q[own] > k]
        if len(inside):
            out[inside] = RangeMin(a).of(first[inside] - k * chunk, last[inside] - k * chunk)
        if len(across):
            out[across] = np.minimum.accumulate(a[::-1])[::-1][first[across] - k * chunk]
        ending = by_last[slice(*np.searchsorted(q[by_last], [k, k + 1]))]
        ending = ending[p[ending] < k]
        if len(ending):
            out[ending] = np.minimum(out[ending], np.minimum.accumulate(a)[last[ending] - k * chunk])
        lows.append(a.min())
    far = np.flatnonzero(q > p + 1)
    if len(far):
        out[far] = np.minimum(out[far], RangeMin(np.array(lows, np.int16)).of(p[far] + 1, q[far] - 1))
    return out


def collection_bwt(symbols: np.ndarray, lengths: np.ndarray, folder: str, chunk: int = 1 << 18, counted: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Suffixes of all documents of a collection in order, in parts: (document, length of the suffix, LCP with the suffix before).

    symbols holds the documents back to front, one row each: column j is the j-th symbol from the end, a number from 0 up. The
    column-wise construction inserts the suffixes of length j + 1 of all documents in round j. A new suffix cS goes among those that
    begin with c, before the ones whose rest comes after S; its place follows from the place that S took in the round before. Its common
    prefix with a neighbour cS' is one more than the least of those between S' and S. End marks sort before all symbols, by document.

    The BWT, the common prefixes, the places of rests and the owners of suffixes are files, read from front to end in parts of `chunk`
    entries and written anew in order in every round. Memory holds some numbers for each document, a part of each file, and, for
    collections of up to `counted` suffixes, a count for each place, which is looked up faster than it is searched for.
    """
    m, longest = symbols.shape
    files, low = Streams(folder, chunk), np.int64((1 << 32) - 1)
    try:
        for j in range(longest):
            files.start(f"column{j}", symbols[:, j].astype(np.int32))
        column = lambda j: np.concatenate([np.zeros(0, np.int32), *files.parts(f"column{j}")])
        files.start("bwt", np.where(lengths > 0, column(0) if longest else 0, -1).astype(np.int32))  # -1: an end mark comes before
        files.start("lcp", np.zeros(m, np.int16))
        files.start("order", np.full(m, -1, np.int64))  # the first symbol of each suffix and the place of its rest
        files.start("owner", np.arange(m, dtype=np.int64) << 16)  # document and length
        at, total = np.arange(m), m
        for j in range(longest):
            live = np.flatnonzero(lengths > j)
            if not len(live):
                break
            live = live[np.argsort(at[live])]
            place, symbol, s = at[live], np.empty(len(live), np.int64), 0
            for a in files.parts("bwt"):
                b, e = np.searchsorted(place, [s, s + len(a)])
                symbol[b:e] = a[place[b:e] - s]
                s += len(a)
            own = symbol << 32 | place
            order = np.argsort(own)
            live, own = live[order], own[order]
            # where new suffixes go, and the ones that stand there now
            goes, before, after, s, done, last = np.full(len(own), total), np.empty(len(own), np.int64), np.full(len(own), -1, np.int64), 0, 0, np.int64(-1)
            for a in files.parts("order"):
                e = np.searchsorted(own, a[-1])
                here = np.searchsorted(a, own[done:e])
                goes[done:e], after[done:e] = here + s, a[here] if len(here) else after[done:e]
                before[done:e] = np.where(here > 0, a[here - 1], last) if len(here) else before[done:e]
                s, done, last = s + len(a), e, a[-1]
            before[done:] = last
            joint = np.concatenate([[False], goes[1:] == goes[:-1]])
            before[joint] = own[:-1][joint[1:]]
            ends = np.flatnonzero(np.concatenate([goes[1:] != goes[:-1], [True]]) & (goes < total))  # an old suffix comes next
            here, there = np.concatenate([own, after[ends]]), np.concatenate([before, own[ends]])
            common, same = np.zeros(len(here), np.int16), here >> 32 == there >> 32
            if same.any():
                common[same] = 1 + range_minima(files.parts("lcp"), chunk, (there[same] & low) + 1, here[same] & low)
            if total <= counted:
                fewer = np.cumsum(np.bincount(goes, minlength=total + 1)).astype(np.int32)  # new suffixes at or before a place
                moved = lambda x: x + fewer[x]
            else:
                moved = lambda x: x + np.searchsorted(goes, x, "right")
            nxt = np.full(len(live), -1, np.int32)
            if j + 1 < longest:
                more = lengths[live] > j + 1
                nxt[more] = column(j + 1)[live[more]]
            new = {"bwt": nxt, "lcp": common[: len(own)], "order": own & ~low | moved(own & low), "owner": live.astype(np.int64) << 16 | (j + 1)}
            for name, fresh in new.items():
                s = b = 0
                with files.writer(name) as out:
                    for a in files.parts(name):
                        end = s + len(a) == total
                        e = len(goes) if end else np.searchsorted(goes, s + len(a))
                        if name == "order":
                            a = np.where(a >= 0, a & ~low | moved(np.where(a >= 0, a & low, 0)), a)
                        elif name == "lcp":
                            c, d = np.searchsorted(goes[ends], [s, s + len(a)])
                            a = a.copy()
                            a[goes[ends[c:d]] - s] = common[len(own) + c : len(own) + d]
                        files.put(out, np.insert(a, goes[b:e] - s, fresh[b:e]))
                        s, b = s + len(a), e
                files.over(name)
            at[live] = goes + np.arange(len(own))
            total += len(own)
        for owner, lcp in zip(files.parts("owner"), files.parts("lcp")):
            yield (owner >> 16).astype(np.int32), (owner & 0xFFFF).astype(np.int32), lcp
    finally:
        files.close()


def anchors(h: np.ndarray, least: int) -> np.ndarray:
    """Places of 8-word runs such that every passage of `least` words holds one, chosen by content: least hash in a window."""
    g = shingles(h, GRAM)
    w = least - GRAM + 1
    if len(g) < w:
        return np.zeros(0, np.int64)

    def sliding(x: np.ndarray, f) -> np.ndarray:
        span = 1
        while 2 * span <= w:
            x, span = f(x[:-span], x[span:]), 2 * span
        return f(x[: len(x) - (w - span)], x[w - span :]) if w > span else x

    low = sliding(g, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    # All of equals are taken: which ones a window holds depends on its words alone.
    return np.flatnonzero(g == sliding(np.concatenate([edge, low, edge]), np.maximum))


def _joined(batch: pa.RecordBatch, at_once: int = 200_000) -> Iterator[tuple]:
    """The documents of a batch end to end, a mark between them: (rows of the batch, words, where documents begin and end)."""
    rows, words, begin, end = [], [], [], []
    for i, text in enumerate(batch["text"].to_pylist()):
        rows.append(i)
        begin.append(len(words))
        words += text.split()
        end.append(len(words))
        words.append(" ")
        if len(words) >= at_once:
            yield rows, words, np.array(begin), np.array(end)
            rows, words, begin, end = [], [], [], []
    if rows:
        yield rows, words, np.array(begin), np.array(end)


def _contexts(h: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int):
    """Of documents end to end: contexts of GRAM + half words, with up to `half` words on either side, that passages have to share.

    (document, its hash, the hash of all with the sides, where it begins, words to its left, words to its right). A passage of `least`
    words around an anchor holds half of its other words on one side of the anchor at least, so it holds a context whole.
    """
    half = (least - GRAM) // 2
    size, side = GRAM + half, least - GRAM - half
    p = anchors(h, least)
    place = np.concatenate([p - half, p])
    left = np.concatenate([np.ones(len(p), bool), np.zeros(len(p), bool)])
    of = np.searchsorted(begin, np.concatenate([p, p]), "right") - 1
    ok = (place >= begin[of]) & (place + size <= end[of])
    place, left, of = place[ok], left[ok], of[ok]
    a, b = np.minimum(place - begin[of], side), np.minimum(end[of] - place - size, side)
    ok = a + b >= side
    place, left, of, a, b = place[ok], left[ok], of[ok], a[ok], b[ok]
    padded = np.concatenate([np.zeros(side, np.uint64), h, np.zeros(side, np.uint64)])
    powers = mix(np.arange(1, size + 2 * side + 1, dtype=np.uint64)) | np.uint64(1)
    key, whole = np.empty(len(place), np.uint64), np.empty(len(place), np.uint64)
    offs = np.arange(size + 2 * side)
    with np.errstate(over="ignore"):
        for part in np.array_split(np.arange(len(place)), len(place) * len(offs) // 1_500_000 + 1):
            w = mix(padded[place[part, None] + offs]) * powers
            inside = w[:, side : side + size].sum(1)
            w[offs < (side - a[part])[:, None]] = 0
            w[offs >= (side + size + b[part])[:, None]] = 0
            key[part] = mix(inside + left[part])
            whole[part] = mix(w.sum(1) + (a[part] << 16 | b[part]).astype(np.uint64))
    return of, key, whole, place - begin[of], a, b


def _keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            names = batch["doc"].to_numpy()
            for rows, words, begin, end in _joined(batch):
                of, key, whole, place, a, b = _contexts(hashes.of(words), begin, end, least)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(names[np.array(rows)][of]), pa.array(place.astype(np.int32)), pa.array((a << 16 | b).astype(np.int32))], ["key", "whole", "doc", "place", "sides"])

    return run


def _segments(least: int):
    """The words beside each wanted context, as their lower 32 bits, with the context's key between them."""
    size = GRAM + (least - GRAM) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, wanted in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), batch["wanted"].to_pylist()):
                h = hashes.of(text.split()).astype(np.uint32)
                for x in wanted:
                    p, a, b = x["place"], x["sides"] >> 16, x["sides"] & 65535
                    for o, v in zip(out, (x["key"], x["whole"], doc, p - a, h[p - a : p].tobytes(), h[p + size : p + size + b].tobytes())):
                        o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["key", "whole", "doc", "begin", "left", "right"])

    return run


def _hits(suffixes: Iterator[tuple], width: int, lengths: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of the windows that occur at more than one place: suffixes agree in `width` symbols, and hold the context. A run
    of such suffixes that a part ends within is carried into the next."""
    found, held = [], [np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int16)]

    def settle(doc: np.ndarray, length: np.ndarray, lcp: np.ndarray) -> None:
        off, start = lengths[doc] - length, np.flatnonzero(lcp < width)
        run = np.cumsum(lcp < width) - 1
        apart = np.minimum.reduceat(low[doc] + off, start) != np.maximum.reduceat(high[doc] + off, start)
        hit = (length >= width) & (off <= left[doc]) & apart[run]
        found.append((doc[hit], off[hit]))

    for part in suffixes:
        held = [np.concatenate(x) for x in zip(held, part)]
        begins = np.flatnonzero(held[2] < width)
        if len(begins) and begins[-1] > 0:
            settle(*(x[: begins[-1]] for x in held))
            held = [x[begins[-1] :] for x in held]
    if len(held[0]):
        settle(*held)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (held[0], held[1])


def _repeats(least: int, folder: str):
    """Of one collection of segments, the stretches of `least`-word windows that occur at more than one place.

    The context of a segment is one symbol, so a window that holds it is side + 1 symbols long, wherever it begins."""
    side, size = least - GRAM - (least - GRAM) // 2, GRAM + (least - GRAM) // 2
    empty = pa.table({"doc": pa.array([], pa.int64()), "start": pa.array([], pa.int32()), "end": pa.array([], pa.int32())})

    def run(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return empty
        contents = np.stack([t["key"].to_numpy(), t["whole"].to_numpy()], 1)
        _, first, of = np.unique(contents, axis=0, return_index=True, return_inverse=True)
        of = of.ravel()
        docs, begin = np.unique(t["doc"].to_numpy(), return_inverse=True)[1], t["begin"].to_numpy().astype(np.int64)
        spot = docs.astype(np.int64) << 32 | begin
        m = len(first)
        low, high = np.full(m, np.iinfo(np.int64).max), np.full(m, -1)
        np.minimum.at(low, of, spot)
        np.maximum.at(high, of, spot)
        some = t.take(pa.array(first)).combine_chunks()
        lefts, rights = some["left"].to_pylist(), some["right"].to_pylist()
        a, b = np.array([len(x) // 4 for x in lefts]), np.array([len(x) // 4 for x in rights])
        words, ids = np.unique(np.frombuffer(b"".join(lefts + rights), np.uint32), return_inverse=True)
        lengths = a + b + 1
        symbols = np.full((m, 2 * side + 1), -1, np.int32)

        def put(count: np.ndarray, ids: np.ndarray, last: np.ndarray) -> None:
            row = np.repeat(np.arange(m), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            symbols[row, last[row] - nth] = ids

        put(a, ids[: a.sum()], lengths - 1)
        put(b, ids[a.sum() :], b - 1)
        symbols[np.arange(m), b] = len(words) + np.unique(some["key"].to_numpy(), return_inverse=True)[1]
        d, o = _hits(collection_bwt(symbols, lengths, folder), side + 1, lengths, a, low, high)
        if not len(d):
            return empty
        order = np.lexsort((o, d))
        d, o = d[order].astype(np.int64), o[order].astype(np.int64)
        new = np.concatenate([[True], d[1:] != d[:-1]])  # within a segment all windows overlap
        ends = np.concatenate([np.flatnonzero(new)[1:], [len(d)]]) - 1
        from_, to = np.full(m, -1), np.full(m, -1)
        from_[d[new]], to[d[new]] = o[new], o[ends] + least
        has = from_[of] >= 0
        return pa.table({"doc": t["doc"].combine_chunks().filter(pa.array(has)), "start": (begin + from_[of])[has].astype(np.int32), "end": (begin + to[of])[has].astype(np.int32)})

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, per_collection: int = 30_000, hot_at: int = 100_000) -> DataFrame:
    """Rows (doc_id, start, length): the stretches of words, of `least` or more, of which every window of `least` words occurs elsewhere too.

    Words are runs without white space, and must agree exactly (by 64-bit hash); elsewhere is another place of any document, the same
    one included. Stretches that overlap or touch are joined.

    Two equal passages of `least` words choose an anchor alike, so they share its left or its right context, of 29 words if least is
    50. Contexts that occur once are done with. The others are gathered, with the words beside them, into collections of about
    per_collection segments, for column-wise construction of their BWT and common prefixes; as all windows in question hold a context
    whole, it is one symbol. Rounds are as many as a segment has symbols, at any size of the corpus. Equal segments go in once. Beside
    64-bit hashes of contexts, words are compared by 32 bits there.

    A context of over hot_at documents, going by one in SAMPLED, would make one task of them all. The most frequent HOT_KEYS of these
    are settled the other way, with the same result: all windows around them are hashed and counted, which combines before it
    shuffles. No other context has more than about one part in HOT_KEYS of all.

    Null, empty and short texts have no rows. Rows equal in id and text are one document. A null id is kept. Long texts are searched
    whole. Other columns are not used.
    """
    if not GRAM + 2 <= least <= 30_000:
        raise ValueError(f"passages of fewer than {GRAM + 2} or more than 30,000 words are not supported")
    spark = docs.sparkSession
    slim = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col)["a"].alias("doc"))
    keys_of = lambda x: x.select("doc", "text").mapInArrow(_keys(least), "key bigint, whole bigint, doc bigint, place int, sides int")
    spot = F.struct("doc", "place")

    def segments(again: DataFrame) -> DataFrame:
        """Occurrences with the words beside them, which are read again from the texts that hold any."""
        wanted = again.groupBy("doc").agg(F.collect_list(F.struct("key", "whole", "place", "sides")).alias("wanted"))
        slots = F.broadcast(again.select(F.pmod(F.xxhash64("doc"), F.lit(SLOTS)).alias("slot")).distinct())
        some = slim.withColumn("slot", F.pmod(F.xxhash64("doc"), F.lit(SLOTS))).join(slots, "slot", "left_semi").join(wanted, "doc").select("doc", "text", "wanted")
        return some.mapInArrow(_segments(least), "key bigint, whole bigint, doc bigint, begin int, left binary, right binary")

    sample = keys_of(slim.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0)).groupBy("key").agg(F.count_distinct("doc").alias("count")).where(F.col("count") * SAMPLED >= hot_at)
    hot = [r.key for r in sample.orderBy(F.col("count").desc(), "key").limit(HOT_KEYS).collect()]
    listed = spark.createDataFrame([(k,) for k in hot], "key bigint")
    keys, w = keys_of(slim), Window.partitionBy("key")
    cold = keys.join(F.broadcast(listed), "key", "left_anti") if hot else keys
    again = save(cold.select("key", "whole", "doc", "place", "sides", F.min(spot).over(w).alias("low"), F.max(spot).over(w).alias("high")).where("low <> high").select("key", "whole", "doc", "place", "sides"), "again")
    symbols = least - GRAM - (least - GRAM) // 2
    collections = again.count() * (2 * symbols + 1) // (43 * per_collection) + 1
    gathered = segments(again).withColumn("collection", F.pmod(F.xxhash64("key"), F.lit(collections)))
    found = save(gathered.groupBy("collection").applyInArrow(_repeats(least, f"{run_dir(spark)}/collections"), "doc bigint, start int, end int"), "stretches")
    drop(again)
    if hot:
        more = save(keys.join(F.broadcast(listed), "key", "left_semi"), "hot")
        windows = save(segments(more).mapInArrow(_windows(least), "window bigint, doc bigint, start int"), "windows")
        place = F.struct("doc", "start")
        twice = windows.groupBy("window").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("window")
        found = found.unionByName(save(windows.join(twice, "window").select("doc", "start", (F.col("start") + least).alias("end")).distinct(), "stretches"))
        drop(more)
        drop(windows)
    by = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    joined = found.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by)).groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ids = slim.select("doc", "id").dropDuplicates(["doc"])
    return joined.join(ids, "doc").select(F.col("id").alias(id_col), F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("length"))


def oracle(least: int = 50) -> str:
    return f"""
with w as (select doc_id, regexp_extract_all(text, '\\S+') as ws from documents),
p as (select doc_id, s, md5(array_to_string(ws[s + 1 : s + {least}], ' ')) as h from w, unnest(range(0, len(ws) - {least - 1})) as t(s) where len(ws) >= {least}),
r as (select doc_id, s from p where h in (select h from p group by h having count(*) > 1)),
i as (select doc_id, s, sum(case when s - prev <= {least} then 0 else 1 end) over (partition by doc_id order by s) as island from (select doc_id, s, lag(s) over (partition by doc_id order by s) as prev from r))
select doc_id, min(s)::bigint as start, (max(s) + {least} - min(s))::bigint as length from i group by doc_id, island"""
