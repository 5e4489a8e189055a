"""What the corpus operators share: reading tables, names for columns, and stable word hashes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.tables import drop, run_dir, save  # noqa: F401

#: Driver-held sets (hot hashes, lexicons) are broadcast up to this many entries; beyond it operators join instead.
BROADCAST_ENTRIES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, unlike any that df has, in capitals or not."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def columns(df: DataFrame, *without: str) -> list[Column]:
    """The columns of df, whatever their names hold, but those named so (in capitals or not)."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in without]


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process. It forgets everything once it holds `most` words, so memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode())
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for every k consecutive entries of h (fewer than k give none)."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        return mix(out)


def row_key(id_col: str, text_col: str):
    """A 128-bit identity of a row's id and text as two longs; rows that agree in both share it, null or not."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit("\0null"))
    i = F.coalesce(F.col(id_col).cast("string"), F.lit("\0null"))
    return F.struct(F.xxhash64(i, t).alias("a"), F.xxhash64(t, F.lit(1), i).alias("b"))
