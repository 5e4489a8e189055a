"""Quality classifier: histogram gradient-boosted trees over statistics of a document."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = (
    "log_chars log_words mean_word unique_words alpha digit upper punctuation mark_words top_word repeats log_lines line_words "
    "repeated_lines ended_lines tailed_words short_words capital_words ended_words doubled_ends"
).split()
_ENDS = frozenset(".!?,;:")
_TAILS = frozenset("#$%&*+-/<=>@\\^_`|~")  # marks that prose has no use for at the end of a word
_KIND = np.zeros(129, np.uint8)  # 0 white space, 1 lower, 2 upper, 3 digit, 4 other, 5 beyond ASCII
_KIND[33:127] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128] = 1, 2, 3, 5


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text, in the order of NAMES; null counts as empty, and an empty text has zeros."""
    out = np.zeros(len(NAMES), np.float32)
    words = (text or "").split()
    if not words:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_KIND[np.minimum(codes, 128)], minlength=6)
    solid, n = max(1, len(codes) - kinds[0]), len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    tailed = sum(c for w, c in counts.items() if len(w) > 1 and w[-1] in _TAILS)
    out[:] = (
        np.log1p(len(codes)), np.log1p(n), solid / n, len(counts) / n, (kinds[1] + kinds[2] + kinds[5]) / solid, kinds[3] / solid, kinds[2] / solid, kinds[4] / solid,
        sum(c for w, c in counts.items() if not (w[0].isalnum() or any(map(str.isalnum, w)))) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, np.log1p(len(lines)), n / len(lines),
        1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), tailed / n,
        sum(c for w, c in counts.items() if len(w) <= 3) / n, sum(c for w, c in counts.items() if w.isupper() and len(w) > 3) / n,
        sum(c for w, c in counts.items() if w[-1] in ".!?") / n, sum(c for w, c in counts.items() if len(w) > 2 and w[-1] == w[-2] in _ENDS) / n,
    )
    return out


@dataclass
class Forest:
    """Complete trees of one depth in flat arrays: node k of a tree has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same shape; greater goes right
    leaf: np.ndarray  # (trees, 2**depth)
    base: float
    cut: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, all rows walking down a tree at once."""
        total, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - inner]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Forest:
    """Boosts trees on logistic loss; splits are sought over histograms of binned features, a level at a time."""
    n, d = x.shape
    inner = 2**depth - 1
    p = (y.sum() + 1) / (len(y) + 2) if len(y) else 1 - 1e-6
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)), float(np.log(p / (1 - p))))
    if n == 0 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)
    flat = binned + np.arange(d) * bins
    margin = np.full(n, forest.base)
    for k in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, np.maximum(prob * (1 - prob), 1e-9)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            key = ((at - first)[:, None] * (d * bins) + flat).ravel()
            sums = [np.bincount(key, np.repeat(v, d), minlength=nodes * d * bins).reshape(nodes, d, bins).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, cl), (ga, ha, ca) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(cl < least) | (ca - cl < least)] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            for node, b in enumerate(best):
                f, e = divmod(int(b), bins)
                if gain[node, f, e] > 1e-7 and e < len(edges[f]):
                    forest.feature[k, first + node], forest.threshold[k, first + node] = f, edges[f][e]
            at = 2 * at + 1 + (x[np.arange(n), forest.feature[k][at]] > forest.threshold[k][at])
        leaf = at - inner
        forest.leaf[k] = rate * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + ridge)
        margin += forest.leaf[k][leaf]
    return forest


def _stats_udf():
    @F.arrow_udf("array<float>")
    def f(a: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in a.to_pylist()], pa.list_(pa.float32()))

    return f


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 20_000, keep_good: float = 0.998) -> Forest:
    """Trains on at most max_labels labelled documents, the ones whose ids hash lowest; a fifth is held out.

    The cut is the score that keep_good of the held-out good documents reach, but 0.5 at most: good documents are to stay.
    An id with several labels counts as its lowest; labels that are null or of unknown documents are not used. Without labels, or
    with labels of one kind only, nothing is rejected.
    """
    known = labels.where("quality is not null").groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("__q"))
    sample = known.where("__id is not null").orderBy(F.xxhash64("__id"), "__id").limit(max_labels)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id").select("__id", "__q", _stats_udf()("__text").alias("x")).toPandas()
    rows = rows.sort_values(["__id"], kind="stable").drop_duplicates("__id")
    if rows.empty or rows["__q"].nunique() < 2:
        forest = train(np.zeros((0, len(NAMES)), np.float32), np.zeros(0))
        forest.cut = -1.0
        return forest
    x, y = np.stack(rows["x"].to_numpy()).astype(np.float32), (rows["__q"].to_numpy() > 0).astype(float)
    held = np.arange(len(y)) % 5 == 0
    forest = train(x[~held], y[~held])
    good = np.sort(forest.scores(x[held & (y > 0)]))
    forest.cut = min(0.5, float(good[int((1 - keep_good) * len(good))])) if len(good) else -1.0
    return forest


def score(forest: Forest, text: Column) -> Column:
    @F.arrow_udf("double")
    def f(a: pa.Array) -> pa.Array:
        x = np.stack([statistics(t) for t in a.to_pylist()]) if len(a) else np.zeros((0, len(NAMES)), np.float32)
        return pa.array(forest.scores(x))

    return f(text)


def classify(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, keep) for every row of docs, repeated ones too; a null or empty text has the score of one without words."""
    return docs.select(F.col(id_col), score(forest, F.col(text_col)).alias("score")).withColumn("keep", F.col("score") >= forest.cut)


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    return docs.where(score(forest, F.col(text_col)) >= forest.cut)
