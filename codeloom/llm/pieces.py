"""SentencePiece encoding and decoding of merge models, with seeded merge-dropout."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import mix

SPACE = "▁"
_MASK = (1 << 64) - 1
_LITERAL = "\0" + SPACE  # a U+2581 of the text itself, which no piece may take for a space
_NONE = 1 << 60
_PLACE, _NO_PAIR, _FREE = 5, np.int32((1 << 31) - 1), np.int64(-1 << 62)
_K1, _K2, _K3, _K4 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9))
_K123 = np.uint64(int(_K1) + int(_K2) + int(_K3) & _MASK)


def _hash(base: int, a: int, b: int, c: int) -> int:
    x = base * (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) & _MASK
    return (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & _MASK


class Pieces:
    """The pieces of a model: the ranks of merges, the ids, and the bytes that ids stand for."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.ids, self.ranks, self.bytes = {}, {}, [b""] * n
        self.byte_ids = [0] * 256
        by_score = sorted((i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))), key=lambda i: (-sp.get_score(i), i))
        for rank, i in enumerate(by_score):
            piece = sp.id_to_piece(i)
            self.ids[piece], self.ranks[piece] = i, rank
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:-1], 16)
                self.byte_ids[b], self.bytes[i] = i, bytes([b])
        self.all_bytes, self.n_bytes = np.frombuffer(b"".join(self.bytes), np.uint8), np.array([len(x) for x in self.bytes], np.int64)
        self.bytes_at = np.cumsum(self.n_bytes) - self.n_bytes
        # Where no piece can reach across a mark, words on either side are merged apart, which lets them be remembered.
        self.breaks_at_newline = not any("\n" in p and len(p) > 1 for p in self.ids)
        self._tables()
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces across spaces are not supported")

    def units(self, text: str) -> list[str]:
        """The text cut where no merge can pass, each run of spaces going with what follows it; a space goes before the text."""
        if "  " not in text and text[:1] != " " and "\0" not in text:  # the same, faster
            text = f" {text}".replace(" ", "\0 ")
            return list(filter(None, (text.replace("\n", "\0\n\0") if self.breaks_at_newline else text).split("\0")))
        return (_UNITS_AND_LINES if self.breaks_at_newline else _UNITS).findall(" " + text)

    def merge(self, unit: str, drop: float = 0.0, key: int = 0) -> list[int]:
        """The ids of one unit. The agenda yields the best adjacent pair, the leftmost of equals; a pair is skipped for good if the
        hash of the key and the places where its parts begin and end falls below drop. The key should be well mixed (Encoder.keys)."""
        symbols = [SPACE if c == " " else _LITERAL if c == SPACE else c for c in unit] if SPACE in unit else list(unit.replace(" ", SPACE))
        if len(symbols) > 1:
            under = int(drop * (1 << 64))
            base = key | 1
            symbols = self._short(symbols, under, base) if len(symbols) <= 48 else self._long(symbols, under, base)
        out, get = [], self.ids.get
        for s in symbols:
            if (i := get(s)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in (SPACE if s is _LITERAL else s).encode("utf-8", "surrogatepass")]
        return out

    def _tables(self) -> None:
        """For merging many units at once: symbols of characters by code point, and all pairs of symbols that merge, by a perfect hash: the
        key of a pair has a group, whose factor sends it to a slot of its own."""
        self.char = np.full(0x110000, -1, np.int32)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.char[ord(" ")], self.char[ord(SPACE)] = self.char[ord(SPACE)], -1
        self.by_rank = np.fromiter(self.ids.values(), np.int32, len(self.ids))
        found, get = {}, self.ids.get
        for p, rank in self.ranks.items():
            for k in range(1, len(p)):
                a, b = get(p[:k]), get(p[k:])
                if a is not None and b is not None:
                    found[a << 20 | b] = rank << _PLACE
        bits = max(4, (2 * len(found)).bit_length())
        self.to_group, self.to_slot = np.uint64(66 - bits), np.uint64(64 - bits)
        self.factors = np.full(1 << bits - 2, _K2, np.uint64)
        self.slots, self.values = np.full(1 << bits, _FREE, np.int64), np.full(1 << bits, _NO_PAIR, np.int32)
        groups: dict[int, list[int]] = {}
        for key in found:
            groups.setdefault((key * int(_K1) & _MASK) >> int(self.to_group), []).append(key)
        taken = bytearray(1 << bits)
        for g, keys in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            factor = int(_K2)
            while len(at := {(key * factor & _MASK) >> int(self.to_slot) for key in keys}) < len(keys) or any(taken[i] for i in at):
                factor = factor * int(_K4) + 2 & _MASK | 1
            self.factors[g] = factor
            for key in keys:
                i = (key * factor & _MASK) >> int(self.to_slot)
                taken[i], self.slots[i], self.values[i] = 1, key, found[key]

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks, times 2^_PLACE, of what pairs merge to; _NO_PAIR for pairs that don't."""
        pairs = a.astype(np.int64) << 20 | b
        keys = pairs.view(np.uint64)
        slot = (keys * self.factors[(keys * _K1 >> self.to_group).view(np.int64)] >> self.to_slot).view(np.int64)
        return np.where(self.slots[slot] == pairs, self.values[slot], _NO_PAIR)

    def _codes(self, units: list[str]) -> np.ndarray:
        """The symbols of the characters of units; -1 for characters without a piece."""
        return self.char[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]

    def known(self, units: list[str]) -> np.ndarray:
        """Which units have a piece for each character."""
        ends, known = np.cumsum(np.fromiter(map(len, units), np.int64, len(units))), np.ones(len(units), bool)
        known[np.searchsorted(ends, np.flatnonzero(self._codes(units) < 0), "right")] = False
        return known

    def replay(self, units: list[str], skips: np.ndarray | None = None, bases: np.ndarray | None = None, under: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The agendas of many short units of known characters, side by side: in each step every one of them takes its best pair, or
        skips it if skips has the bit of that step or, where bases are given, if the hash with them falls below under. Numbers of the
        pairs offered after the last skip, their places as factors of the hash (neither with bases), numbers of ids, ids."""
        m, n = len(units), np.fromiter(map(len, units), np.int64, len(units))
        bits, w = (m - 1).bit_length(), int(n.max()) + 2
        wide = 1 << bits  # a symbol of unit u at place p is number (p + 1 << bits) + u; on either side is one that merges with none
        unit, codes = np.repeat(np.arange(m), n), self._codes(units)
        at = (np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(n) - n, n) << bits) + unit
        s, rank = np.full(w << bits, -1, np.int32), np.full(w << bits, _NO_PAIR, np.int32)
        s[at] = codes
        at = at[at >> bits < n[unit]]
        rank[at] = self._look(s[at], s[at + wide]) | at >> bits
        table, following, before = rank.reshape(w, wide), np.arange(wide, w + 1 << bits), np.arange(-wide, w - 1 << bits)
        step, skipping = 0, int(skips.max()).bit_length() if skips is not None else 0
        rows, factors = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while len(go := np.flatnonzero((best := table.min(0)) != _NO_PAIR)):
            best = best[go]
            i = ((best & (1 << _PLACE) - 1).astype(np.int64) << bits) + go
            j = following[i]
            k = following[j]
            factor = (i >> bits).view(np.uint64) * _K1 + (j >> bits).view(np.uint64) * _K2 + (k >> bits).view(np.uint64) * _K3 - _K123
            skip = None
            if bases is not None:
                x = bases[go] * factor
                skip = (x ^ x >> np.uint64(29)) * _K4 < under
            elif step < skipping:
                rest = skips[go] >> step
                last, skip = rest == 0, rest & 1 == 1
                rows.append(go[last])
                factors.append(factor[last])
            else:
                rows.append(go)
                factors.append(factor)
            step += 1
            if skip is not None and skip.any():
                rank[i[skip]] = _NO_PAIR
                on = ~skip
                i, j, k, best = i[on], j[on], k[on], best[on]
            p, new = before[i], self.by_rank[best >> _PLACE]
            s[i], s[j], rank[j] = new, -1, _NO_PAIR
            following[i], before[k] = k, i
            at = np.concatenate([p, i])
            rank[at] = self._look(np.concatenate([s[p], new]), np.concatenate([new, s[k]])) | at >> bits
        s = s.reshape(w, wide).T[:m]
        kept, row = s >= 0, np.concatenate(rows)
        return np.bincount(row, minlength=m), np.concatenate(factors)[np.argsort(row, kind="stable")], kept.sum(1), s[kept]

    def _short(self, s: list[str], under: int, base: int) -> list[str]:
        """The agenda as a list of the ranks of adjacent pairs."""
        get = self.ranks.get
        ranks = [get(a + b, _NONE) for a, b in zip(s, s[1:])]
        at = list(range(len(s) + 1))
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            if under:
                x = base * (at[i] * 0x9E3779B97F4A7C15 + at[i + 1] * 0xC2B2AE3D27D4EB4F + at[i + 2] * 0x165667B19E3779F9) & _MASK
                if (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & _MASK < under:
                    ranks[i] = _NONE
                    continue
            s[i] = new = s[i] + s.pop(i + 1)
            del at[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new + s[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(s[i - 1] + new, _NONE)
        return s

    def _long(self, s: list[str], under: int, base: int) -> list[str]:
        """The agenda as a heap over linked symbols, for units of any length."""
        n, get = len(s), self.ranks.get
        end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(a: int, b: int) -> None:
            if (rank := get(s[a] + s[b], _NONE)) != _NONE:
                heapq.heappush(heap, (rank, a, b, end[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if s[a] and s[b] and end[a] == b and end[b] == e and not (under and _hash(base, a, b, e) < under):
                s[a] += s[b]
                s[b], end[a] = "", e
                if e < n:
                    before[e] = a
                    offer(a, e)
                if a:
                    offer(before[a], a)
        return [x for x in s if x]

    def decode(self, ids) -> str:
        """The text of ids, byte pieces joined and the space before the text taken off."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text

    def lossless(self, texts: list[str | None], ids: list[np.ndarray]) -> list[bool | None]:
        """Whether the ids of each text decode to it; None for null."""
        flat, ends = np.concatenate(ids), np.cumsum([0, *map(len, ids)])
        n = self.n_bytes[flat]
        found, ends = self.all_bytes[_runs(self.bytes_at[flat], n)].tobytes(), np.concatenate([[0], np.cumsum(n)])[ends].tolist()
        out: list[bool | None] = []
        for t, b, e in zip(texts, ends, ends[1:]):
            out.append(None if t is None else found[b + (found[b : b + 1] == b" " and b < e) : e] == t.encode("utf-8", "surrogatepass"))
        return out


_UNITS, _UNITS_AND_LINES = re.compile(r" +[^ ]*|[^ ]+"), re.compile(r" +[^ \n]*|\n|[^ \n]+")
_LONGEST = 20  # a unit of so many characters is offered at most 3 * 19 pairs, so the steps skipped fit a number; places are of _PLACE bits


class Column:
    """An array that grows."""

    def __init__(self, kind):
        self.a, self.n = np.zeros(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.a):
            self.a = np.concatenate([self.a[: self.n], np.zeros(self.n + 2 * len(x), self.a.dtype)])
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)


def _runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each start and the n - 1 numbers after it."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def _by_length(units: list[str], at_once: int = 4096) -> list[np.ndarray]:
    """The numbers of the units, shortest first, in parts."""
    order = np.argsort(np.fromiter(map(len, units), np.int64, len(units)), kind="stable")
    return np.split(order, range(at_once, len(order), at_once))


_APART, _ONCE, _NEVER = -1, -2, -3


class Ways:
    """The ways to cut units. A way is a unit and the steps of its agenda skipped so far; it has the pairs offered from there on, each
    with the way that skipping it leads to, and the ids that come out if none of them is skipped. What occurrences share is only what
    follows from the merges that they skip, so remembering changes no result. A way is made when it is asked for again (_ONCE: asked for
    once); before that, an occurrence that comes to it has its agenda run by itself, at once to its end."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.names: list[str] = []  # by number
        self.chars = 0  # of the names
        self.units: list[str] = []
        self.skips, self.at, self.n, self.ids_at, self.n_ids = (Column(np.int64) for _ in range(5))
        self.roots, self.factors, self.to, self.ids = Column(np.int32), Column(np.uint64), Column(np.int32), Column(np.int32)

    def forget_rare(self) -> None:
        """Forgets the units without a way."""
        kept = np.flatnonzero(self.roots.a[: self.roots.n] >= 0)
        roots, self.names, self.roots = self.roots.a[kept], [self.names[i] for i in kept.tolist()], Column(np.int32)
        self.numbers = defaultdict(count(len(kept)).__next__, zip(self.names, range(len(kept))))
        self.roots.add(roots)
        self.chars = sum(map(len, self.names))

    def _add(self, units: list[str], skips: np.ndarray, n: np.ndarray, factors: np.ndarray, n_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
        first = len(self.units)
        self.units += units
        self.skips.add(skips)
        self.at.add(self.factors.n + np.cumsum(n) - n)
        self.n.add(n)
        self.ids_at.add(self.ids.n + np.cumsum(n_ids) - n_ids)
        self.n_ids.add(n_ids)
        self.factors.add(factors)
        self.to.add(np.full(len(factors), _NEVER, np.int32))
        self.ids.add(ids)
        return np.arange(first, first + len(units))

    def make(self, units: list[str], skips: np.ndarray) -> np.ndarray:
        out = np.zeros(len(units), np.int64)
        for some in _by_length(units):
            part = [units[i] for i in some.tolist()]
            out[some] = self._add(part, skips[some], *self.pieces.replay(part, skips[some]))
        return out

    def number(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """The numbers of the units of all texts, and how many each text has. Units without a number get one."""
        out, lengths, get = [], [], self.numbers.__getitem__
        for text in texts:
            had = len(out)
            if text:
                out += map(get, self.pieces.units(text))  # a text at a time, while it is near at hand
            lengths.append(len(out) - had)
        self.names += (new := list(islice(reversed(self.numbers), len(self.numbers) - len(self.names)))[::-1])
        self.chars += sum(map(len, new))
        return np.array(out, np.int64), lengths

    def start(self, number: np.ndarray) -> np.ndarray:
        """The ways that skip nothing; _APART for units that are long or hold characters without a piece, _ONCE for those met once."""
        first = self.roots.n
        if new := self.names[first:]:
            short = np.fromiter(map(len, new), np.int64, len(new)) <= _LONGEST
            known = self.pieces.known(tried := [u for u, k in zip(new, short.tolist()) if k])
            roots = np.full(len(new), _APART, np.int32)
            roots[np.flatnonzero(short)[known]] = _ONCE
            for u in [u for u, k in zip(tried, known.tolist()) if not k and len(u) == 1]:  # bytes, whatever the key
                ids = np.array(self.pieces.merge(u), np.int32)
                roots[self.numbers[u] - first] = self._add([u], np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64), np.array([len(ids)]), ids)[0]
            self.roots.add(roots)
        times = np.bincount(number, minlength=self.roots.n)
        times[:first] *= 2
        due = np.flatnonzero((times > 1) & (self.roots.a[: self.roots.n] == _ONCE))
        if len(due):
            self.roots.a[due] = self.make([self.names[i] for i in due.tolist()], np.zeros(len(due), np.int64))
        return self.roots.a[number].astype(np.int64)

    def follow(self, way: np.ndarray, bases: np.ndarray, under: np.uint64) -> None:
        """Moves each occurrence, in place, to the way that its key leads to; _ONCE where that is to be made yet."""
        todo = np.flatnonzero(way >= 0)
        while len(todo):
            w = way[todo]
            n = self.n.a[w]
            at = _runs(self.at.a[w], n)
            x = np.repeat(bases[todo], n) * self.factors.a[at]
            hit = np.flatnonzero((x ^ (x >> np.uint64(29))) * _K4 < under)
            owner = np.searchsorted(np.cumsum(n), hit, "right")
            first = np.diff(owner, prepend=-1) > 0
            owner, pair = owner[first], at[hit[first]]
            todo, w = todo[owner], w[owner]
            open_ = np.flatnonzero(self.to.a[pair] < 0)
            new, some, times = np.unique(pair[open_], return_index=True, return_counts=True)
            if len(new):
                due = (self.to.a[new] == _ONCE) | (times > 1)
                self.to.a[new] = _ONCE
                if len(new := new[due]):
                    w = w[open_[some[due]]]
                    skips = self.skips.a[w]
                    step = np.array([x.bit_length() for x in skips.tolist()]) + new - self.at.a[w]
                    self.to.a[new] = self.make([self.units[i] for i in w.tolist()], skips | np.int64(1) << step)
            way[todo] = self.to.a[pair]
            todo = todo[way[todo] >= 0]

    def alone(self, units: list[str], bases: np.ndarray, under: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and ids, of occurrences whose agendas are run by themselves."""
        n, parts, order = np.zeros(len(units), np.int64), [], _by_length(units)
        if not units:
            return n, np.zeros(0, np.int32)
        for some in order:
            _, _, n[some], ids = self.pieces.replay([units[i] for i in some.tolist()], bases=bases[some], under=under)
            parts.append(ids)
        order, ids = np.concatenate(order), np.concatenate(parts)
        at = np.zeros(len(units), np.int64)
        at[order] = np.cumsum(n[order]) - n[order]
        return n, ids[_runs(at, n)]

    def join(self, way: np.ndarray, apart: list[list[int]], alone: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and ids, of all occurrences; apart and alone: those of the ways _APART and _ONCE."""
        n, kept = np.zeros(len(way), np.int64), way >= 0
        n[kept], n[way == _APART], n[way == _ONCE] = self.n_ids.a[way[kept]], [len(x) for x in apart], alone[0]
        out, of = np.zeros(n.sum(), np.int32), np.repeat(np.minimum(way, 0), n)
        out[of == 0] = self.ids.a[_runs(self.ids_at.a[way[kept]], n[kept])]
        out[of == _APART] = [i for x in apart for i in x]
        out[of == _ONCE] = alone[1]
        return n, out


class Encoder:
    """Encodes texts. Each unit of a text has a key of its own, a hash of the seed, the document and its place, so each occurrence of a
    word has its own skips, the same in every run. Units without a way are forgotten once there are more than `most` units, and all once
    there are more than `most` ways, which changes no result."""

    def __init__(self, pieces: Pieces, drop: float = 0.1, seed: int = 1, most: int = 800_000):
        self.pieces, self.drop, self.seed, self.most, self.ways = pieces, drop, seed, most, Ways(pieces)

    def keys(self, n: int, doc_key: int) -> np.ndarray:
        """The keys of the first n units of a document."""
        return self._keys([n], [doc_key])

    def _keys(self, lengths: list[int], doc_keys: list[int]) -> np.ndarray:
        n, of = np.array(lengths, np.int64), np.array([(k ^ self.seed * 0xD6E8FEB86659FD93) & _MASK for k in doc_keys], np.uint64)
        return mix(_runs(np.zeros(len(n), np.int64), n).view(np.uint64) * _K1 + np.repeat(of, n))

    def encode(self, text: str | None, doc_key: int = 0) -> np.ndarray:
        return self.encode_many([text], [doc_key])[0]

    def encode_many(self, texts: list[str | None], doc_keys: list[int]) -> list[np.ndarray]:
        """The ids of each text."""
        ways = self.ways
        if full := len(ways.names) > self.most or ways.chars > 16 * self.most:
            ways.forget_rare()
        if len(ways.units) > self.most or full and len(ways.names) > self.most // 2:
            ways.clear()
        number, lengths = ways.number(texts)
        if not len(number):
            return [np.zeros(0, np.int32) for _ in texts]
        keys = self._keys(lengths, doc_keys)
        bases, under = keys | np.uint64(1), np.uint64(min(int(self.drop * (1 << 64)), _MASK))
        way = ways.start(number)
        if self.drop:
            ways.follow(way, bases, under)
        apart, once = np.flatnonzero(way == _APART), np.flatnonzero(way == _ONCE)
        others = [self.pieces.merge(ways.names[i], self.drop, k) for i, k in zip(number[apart].tolist(), keys[apart].tolist())]
        n, ids = ways.join(way, others, ways.alone([ways.names[i] for i in number[once].tolist()], bases[once], under))
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *lengths])]
        return [ids[b:e] for b, e in zip(ends[:-1], ends[1:])]


_here: dict[int, Encoder] = {}


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", drop: float = 0.1, seed: int = 1) -> DataFrame:
    """Rows (doc_id, ids, n_ids, lossless) for every row of docs; lossless says that the ids decode to the very text.

    Spaces are kept, one more goes before the text, characters without a piece become bytes, and a U+2581 of the text becomes bytes too
    (it would decode to a space). An empty text has no ids; a null one has null ids and null for the others. The key of a document is
    its id, so repeated rows are cut alike; a null id is a key of its own. Other columns are not used. drop=0 is plain encoding.
    """
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model_file))
    number = hash((model_file, drop, seed))

    @F.arrow_udf("struct<ids:array<int>,lossless:boolean>")
    def run(text: pa.Array, key: pa.Array) -> pa.Array:
        if number not in _here:
            _here.clear()
            _here[number] = Encoder(held.value, drop, seed)
        e = _here[number]
        flat, exact, texts, keys = [], [], text.to_pylist(), key.to_pylist()
        b = chars = 0
        for i, t in enumerate(texts):
            chars += len(t or "")
            if chars >= 1_000_000 or i + 1 == len(texts):
                flat += (ids := e.encode_many(texts[b : i + 1], keys[b : i + 1]))
                exact += e.pieces.lossless(texts[b : i + 1], ids)
                b, chars = i + 1, 0
        null, offsets = [t is None for t in texts], np.cumsum([0, *map(len, flat)])
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(null, pa.bool_()))
        return pa.StructArray.from_arrays([lists, pa.array(exact, pa.bool_())], ["ids", "lossless"])

    made = docs.select(F.col(id_col), run(F.col(text_col), F.xxhash64(F.col(id_col))).alias("e"))
    return made.select(id_col, "e.ids", F.size("e.ids").cast("long").alias("n_ids"), "e.lossless").withColumn("n_ids", F.when(F.col("ids").isNotNull(), F.col("n_ids")))


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, text): the texts of arrays of ids; null gives null and an empty array an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(Pieces(model_file))

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else held.value.decode(x) for x in ids.to_pylist()], pa.string())

    return encoded.select(F.col(id_col), run(F.col(ids_col)).alias("text"))
