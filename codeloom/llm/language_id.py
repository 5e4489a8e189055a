"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.sampling import among_lowest

ORDERS = (1, 2, 3)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def grams(texts: list[str | None], bits: int, chars_at_once: int = 1_000_000):
    """Yields (which texts, buckets) for pieces of the joined lower-cased texts: every n-gram of every whole text, and none across two."""
    at, held, size = 0, [], 0
    for i, text in enumerate([*texts, None]):
        if i == len(texts) or size >= chars_at_once:
            if held:
                yield from _of(held, at, bits)
            at, held, size = i, [], 0
        if i < len(texts):
            held.append((text or "").lower())
            size += len(held[-1])


def _of(texts: list[str], first: int, bits: int):
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(first, first + len(texts)), lengths)
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(codes) < n:
                return
            h = h[: len(codes) - n + 1] + codes[n - 1 :] * _FACTORS[n - 1]
            whole = of[n - 1 :] == of[: len(of) - n + 1]
            x = (h + np.uint64(n)) * _FACTORS[0]
            yield of[: len(of) - n + 1][whole], ((x ^ (x >> np.uint64(29))) * _FACTORS[1] >> np.uint64(64 - bits)).astype(np.int64)[whole]


@dataclass
class NaiveBayes:
    languages: list[str]
    prior: np.ndarray  # log, by language
    table: np.ndarray  # (buckets, languages), log

    @property
    def bits(self) -> int:
        return len(self.table).bit_length() - 1

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Log-probability of each text with each language: rows of the table summed by text, a batch at once."""
        out = np.tile(self.prior, (len(texts), 1))
        for of, bucket in grams(texts, self.bits):
            if len(of):
                start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                out[of[start]] += np.add.reduceat(self.table[bucket], start, axis=0, dtype=np.float64)
        return out


def count(texts: list[str], langs: list[str], bits: int) -> list[tuple[str, int, int]]:
    """How often each bucket occurs in texts of each language, and as bucket -1 how many texts that language has."""
    names, of_lang = np.unique(np.array(langs, object), return_inverse=True)
    out = [(n, -1, c) for n, c in zip(names.tolist(), np.bincount(of_lang, minlength=len(names)).tolist())]
    for of, bucket in grams(texts, bits):
        key, times = np.unique(of_lang[of] << bits | bucket, return_counts=True)
        out += zip(names[key >> bits].tolist(), (key & ((1 << bits) - 1)).tolist(), times.tolist())
    return out


def from_counts(rows: list[tuple[str, int, int]], bits: int, smooth: float) -> NaiveBayes:
    names = sorted({r[0] for r in rows})
    at = {n: k for k, n in enumerate(names)}
    counts, docs = np.full((2**bits, max(1, len(names))), smooth), np.ones(max(1, len(names)))
    for name, bucket, n in rows:
        if bucket < 0:
            docs[at[name]] += n
        else:
            counts[bucket, at[name]] += n
    return NaiveBayes(names, np.log(docs / docs.sum()), np.log(counts / counts.sum(0)).astype(np.float32))


def train(texts: list[str], langs: list[str], bits: int = 16, smooth: float = 0.1) -> NaiveBayes:
    return from_counts(count(texts, langs, bits), bits, smooth)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 4000, bits: int = 16, smooth: float = 0.1) -> NaiveBayes:
    """Trains on about max_docs labelled documents, those whose ids hash lowest, with all of their texts.

    Texts are counted where they are; only sums by language and bucket come to the driver, 2**bits for each language at most. Rows
    without an id, a label or any text are not used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = count(batch["t"].to_pylist(), batch["l"].to_pylist(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], ["l", "bucket", "n"])

    some = among_lowest(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null and t <> ''"), "id", max_docs)
    sums = some.select("t", "l").mapInArrow(run, "l string, bucket bigint, n bigint").groupBy("l", "bucket").agg(F.sum("n").alias("n"))
    return from_counts([tuple(r) for r in sums.collect()], bits, smooth)


def identify(docs: DataFrame, model: NaiveBayes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang, margin) for every row of docs: the likeliest language, and its lead over the next in log-probability a character.

    Ties go to the first language by name. A null or empty text has null for both, and so has any text if the model knows no language;
    the margin is null if it knows one. Whole texts are scored. Repeated rows give repeated rows; other columns are not used.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,margin:double>")
    def best(a: pa.Array) -> pa.Array:
        m, texts = held.value, a.to_pylist()
        s = m.scores(texts)
        top = s.argmax(1)
        lead = np.sort(s, axis=1)[:, ::-1]
        return pa.array([
            {"lang": m.languages[k] if t and m.languages else None, "margin": float(x[0] - x[1]) / len(t) if t and len(m.languages) > 1 else None}
            for t, k, x in zip(texts, top.tolist(), lead)
        ], pa.struct([("lang", pa.string()), ("margin", pa.float64())]))

    def text() -> Column:
        return F.col(text_col)

    return docs.select(F.col(id_col), best(text()).alias("b")).select(id_col, "b.lang", "b.margin")
