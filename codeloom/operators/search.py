"""Symbol search: by substring, and by full text with BM25."""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.names import substring_like
from codeloom.schema import Maybe
from codeloom.sources.tables import save

_RANKS = ("function", "method", "class", "call", "import", "file")
K1, B = 1.2, 0.75
_OPERATORS = {"NOT", "OR", "AND"}


def kind_rank(kind: Column) -> Column:
    out = F.lit(len(_RANKS))
    for i, k in reversed(list(enumerate(_RANKS))):
        out = F.when(kind == k, i).otherwise(out)
    return out


def filtered(nodes: DataFrame, kind: Maybe = None, language: Maybe = None) -> DataFrame:
    if kind:
        nodes = nodes.where(F.col("kind") == kind)
    return nodes.where(F.col("language") == language) if language else nodes


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def by_name(nodes: DataFrame, name: str, kind: Maybe = None) -> DataFrame:
    return filtered(nodes, kind).where(F.col("name") == name).orderBy("file_path", F.col("line_start").asc_nulls_first(), "seq", "id")


def in_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path).orderBy(F.col("line_start").asc_nulls_first(), "seq", "id")


def search_nodes(nodes: DataFrame, text: str, kind: Maybe = None, language: Maybe = None, limit: int = 50) -> DataFrame:
    """Nodes whose name holds text: an exact name first, then by kind, name, and place."""
    hits = filtered(nodes, kind, language).where(substring_like(F.col("name"), text))
    return hits.orderBy(F.when(F.col("name") == text, 0).otherwise(1), kind_rank(F.col("kind")), "name", "file_path", F.col("line_start").asc_nulls_first(), "seq", "id").limit(limit)


def pick_symbol(nodes: DataFrame, name: str) -> DataFrame:
    """The one node that a name stands for: among the ten best, the first of a definition's kind, else the first. Stubs may be picked."""
    top = search_nodes(nodes, name, limit=10)
    w = Window.orderBy(F.when(F.col("name") == name, 0).otherwise(1), kind_rank(F.col("kind")), "name", "file_path", F.col("line_start").asc_nulls_first(), "seq", "id")
    placed = top.withColumn("__place", F.row_number().over(w))
    return placed.orderBy(~F.col("kind").isin("function", "method", "class"), "__place").limit(1).drop("__place")


# Full text. A token is a run of letters and digits, in lower case and without accents; _ separates.


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@cache
def _letters() -> tuple[str, str, str, str]:
    """For translate(): characters that fold() makes one other character, what they become, and those it drops; and a class of all that it
    makes several, and that Python doesn't know, as the JVM may. It takes each character for itself, except that lower() minds where a
    sigma stands."""
    one, to, gone, several = [], [], [], []
    for c in map(chr, [*range(128, 0xD800), *range(0xE000, sys.maxunicode + 1)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) > 1 or unicodedata.category(c) == "Cn":
            several.append(c)
        elif not plain:
            gone.append(c)
        elif plain.lower() != c:
            one.append(c)
            to.append(plain.lower() if len(plain.lower()) == 1 and plain != "\u03a3" else plain)
    runs = []
    for k in map(ord, several):
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    # What most texts consist of is ruled out first: the class has hundreds of ranges.
    return "".join(one), "".join(to), "".join(gone), r"(?![\x{0}-\x{bb}\x{bf}-\x{131}])[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def folded(text: Column) -> Column:
    """fold(). Only texts with a character that becomes several or is unknown go to Python; in place of the others go nulls."""

    @F.arrow_udf("string")
    def f(a: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fold(t) for t in a.to_pylist()], pa.string())

    one, to, gone, several = _letters()
    ascii_, hard = F.regexp_like(text, F.lit(r"^\p{ASCII}*$")), F.regexp_like(text, F.lit(several))
    plain = F.when(ascii_, F.lower(text)).when(~hard, F.lower(F.translate(text, one + gone, to)))
    return F.coalesce(plain, f(F.when(~ascii_ & hard, text)))


def tokens(text: Column) -> Column:
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


class FullTextSyntaxError(ValueError):
    """A query with operators that can't be read."""


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False


@dataclass
class Op:
    name: str
    parts: list = field(default_factory=list)


def parse_query(text: str) -> Phrase | Op:
    """Without operators, one phrase of all words. With a * or a lone AND, OR or NOT: words and "phrases", a * after one for a prefix;
    NOT binds strongest, then AND, which may be left out, then OR; brackets group."""
    if "*" not in text and not _OPERATORS & {*text.split()}:
        return Phrase(_words(text))
    items = re.findall(r'"(?:[^"]|"")*"|[()*]|[^\s"()*]+', text)
    at = 0

    def peek() -> str | None:
        return items[at] if at < len(items) else None

    def take() -> str:
        nonlocal at
        if at >= len(items):
            raise FullTextSyntaxError(f"the query ends too early: {text!r}")
        at += 1
        return items[at - 1]

    def unit():
        x = take()
        if x == "(":
            inner = either()
            if take() != ")":
                raise FullTextSyntaxError(f"a bracket isn't closed: {text!r}")
            return inner
        if x in (")", "*", "AND", "OR", "NOT"):
            raise FullTextSyntaxError(f"{x} is out of place: {text!r}")
        words = _words(x.strip('"'))
        star = peek() == "*"
        if star:
            take()
        return Phrase(words, star)

    def without():
        out = unit()
        while peek() == "NOT":
            take()
            out = Op("NOT", [out, unit()])
        return out

    def both():
        parts = [without()]
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                take()
            parts.append(without())
        return parts[0] if len(parts) == 1 else Op("AND", parts)

    def either():
        parts = [both()]
        while peek() == "OR":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Op("OR", parts)

    out = either()
    if at < len(items):
        raise FullTextSyntaxError(f"{items[at]} is out of place: {text!r}")
    return out


def _words(text: str) -> list[str]:
    return [x for x in re.split(r"[\W_]+", fold(text)) if x]


def phrases(q: Phrase | Op) -> list[Phrase]:
    return [q] if isinstance(q, Phrase) else [p for x in q.parts for p in phrases(x)]


def postings(rows: DataFrame, id_col: str = "id", columns: tuple[str, ...] = ("name", "docstring", "code_snippet")) -> DataFrame:
    """(id, col, words): the tokens of each column, in order. Null columns are empty."""
    return rows.select(F.col(id_col).alias("id"), F.array(*(tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns)).alias("cols"))


def _hits(words: Column, p: Phrase) -> Column:
    """How often a phrase occurs in an array of tokens."""
    n = len(p.words)
    if not n:
        return F.lit(0)

    def at(x: Column, i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(p.words):
            t = F.get(words, i + k) if k else x
            ok = ok & (F.startswith(t, F.lit(w)) if p.prefix and k == n - 1 else t == w)
        return F.coalesce(ok, F.lit(False))

    return F.size(F.filter(words, at))


def _counter(p: Phrase):
    return lambda words: _hits(words, p)


def full_text(rows: DataFrame, query: str, id_col: str = "id", columns: tuple[str, ...] = ("name", "docstring", "code_snippet")) -> DataFrame:
    """(id, score) of the rows that a query matches; lower scores are better.

    A phrase has to stand within one column. Scores are Okapi BM25 (k1 1.2, b 0.75) over phrases: each counts with its own frequency in
    the row and number of rows, and idf is 1e-6 at least; lengths are summed over columns. Statistics are taken over all rows, so
    filter results, not rows. Everything is one pass over the tokens, whose counts are saved, and one row of statistics.
    """
    q = parse_query(query)
    units = phrases(q)
    words = postings(rows, id_col, columns)
    total = lambda f: F.aggregate(F.transform("cols", f), F.lit(0), lambda a, x: a + x)
    freq = words.select("id", total(lambda w: F.size(w)).alias("len"), *(total(_counter(p)).alias(f"f{i}") for i, p in enumerate(units)))
    freq = save(freq, "counts")
    stats = freq.agg(F.count("*").alias("rows"), F.avg("len").alias("avg"), *(F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(units))))
    number = iter(range(len(units)))

    def matches(x: Phrase | Op) -> Column:
        if isinstance(x, Phrase):
            return F.col(f"f{next(number)}") > 0
        first, *others = [matches(p) for p in x.parts]
        for o in others:
            first = first & o if x.name == "AND" else first | o if x.name == "OR" else first & ~o
        return first

    score = F.lit(0.0)
    for i in range(len(units)):
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.greatest(F.log((F.col("rows") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score - F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))).otherwise(0.0)
    hit = matches(q)
    return freq.where(hit).crossJoin(F.broadcast(stats)).select(F.col("id").alias(id_col), score.alias("score"))


def search_full_text(nodes: DataFrame, query: str, kind: Maybe = None, language: Maybe = None, limit: int = 50) -> DataFrame:
    return filtered(nodes, kind, language).join(full_text(nodes, query), "id").orderBy("score", "id").limit(limit)
