"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Every tree is a full binary tree of fixed depth, stored level by level in flat
arrays: the children of node i are 2i + 1 and 2i + 2. A batch of documents walks
all trees at once, one array step per level, without a branch.

Trees are grown on a bounded sample of labelled documents (``SAMPLE_ROWS``); the
statistics are taken on the cluster, only their numbers come to the driver.
Scoring reads each whole text once and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that trees are grown on; those with the smallest hash of their id.
SAMPLE_ROWS = 20_000

TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 64
RIDGE, LEAST_WEIGHT = 1.0, 5.0

# Kinds of bytes that the statistics count.
_KINDS = ["lower", "upper", "digit", "symbol", "mark", "stop", "space", "line", "wide"]
_KIND = np.full(256, 5, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 8
for _b in b"#*$%&|<>@^~_=+\\/{}[]":
    _KIND[_b] = 3
for _b in b"!?":
    _KIND[_b] = 4
for _b in b" \t\r\v\f":
    _KIND[_b] = 6
_KIND[10] = 7

FEATURES = [
    *(f"{k}_share" for k in _KINDS), "log_words", "word_bytes", "distinct_words", "distinct_pairs",
    "same_neighbours", "top_word", "line_words", "distinct_lines", "marked_words", "shouted_words", "lone_bars"]


def statistics(text: bytes) -> list[float]:
    """The numbers a document is judged by, from its UTF-8 text alone; an empty text gives zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=len(_KINDS)) / len(text)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        *kinds.tolist(), float(np.log1p(n)), sum(map(len, words)) / n, len(counts) / n,
        len(set(zip(words, words[1:], strict=False))) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(counts.values()) / n, n / len(lines), len(set(lines)) / len(lines),
        sum(w[-1] in b"#*$%&|!" for w in words) / n, sum(w.isupper() for w in words) / n, counts.get(b"|", 0) / n]


@dataclass
class Forest:
    """Flattened trees: ``split`` and ``bar`` per inner node, ``leaf`` per leaf, one row per tree."""

    edges: np.ndarray  # (features, bins - 1): the bins of a feature
    split: np.ndarray  # (trees, 2^depth - 1): feature
    bar: np.ndarray  # (trees, 2^depth - 1): bins up to this one go left
    leaf: np.ndarray  # (trees, 2^depth)
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        trees, inner = self.split.shape
        if not trees:
            return np.full(len(bins), self.base)
        tree, row = np.arange(trees)[None, :], np.arange(len(bins))[:, None]
        node = np.zeros((len(bins), trees), np.int64)
        while node[0, 0] < inner:
            right = bins[row, self.split[tree, node]] > self.bar[tree, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[tree, node - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row of statistics."""
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.margin(self.binned(x))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Boosted trees for the log loss. Without rows, or with one label only, a constant."""
    features, inner = x.shape[1], 2**depth - 1
    # One more of either label than seen keeps the constant finite.
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    inside = np.linspace(0, 1, bins + 1)[1:-1]
    edges = np.quantile(x, inside, axis=0).T if len(x) else np.zeros((features, bins - 1))
    none = np.zeros((0, inner), np.int64)
    forest = Forest(edges, none, none, np.zeros((0, inner + 1)), base)
    if not 0 < y.sum() < len(y):
        return forest
    binned = forest.binned(x)
    cells = binned + bins * np.arange(features)[None, :]
    margin = np.full(len(y), base)
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        slope, bend = chance - y, chance * (1 - chance)
        split, bar = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (features * bins) + cells).ravel()
            size = width * features * bins
            g, h = (
                np.bincount(at, np.repeat(v, features), minlength=size).reshape(width, features, bins).cumsum(2)
                for v in (slope, bend))
            g_all, h_all = g[..., -1:], h[..., -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(h < LEAST_WEIGHT) | (h_all - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(1)
            found = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            split[first : first + width] = best // bins
            bar[first : first + width] = np.where(found, best % bins, bins)
            node = 2 * node + 1 + (binned[np.arange(len(y)), split[node]] > bar[node])
        leaf_of = node - inner
        g, h = (np.bincount(leaf_of, v, minlength=inner + 1) for v in (slope, bend))
        leaf = -rate * g / (h + RIDGE)
        margin += leaf[leaf_of]
        forest = Forest(
            edges, np.vstack([forest.split, split]), np.vstack([forest.bar, bar]), np.vstack([forest.leaf, leaf]), base)
    return forest


def _texts(column: pa.Array) -> list[bytes]:
    return [t.as_py() or b"" for t in column.cast(pa.binary())]


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Forest:
    """Trees from labelled documents.

    Rows without key or label are left out; of several labels of a key the smaller
    counts. At most ``sample_rows`` keys are used, those with the smallest hash; of several
    rows of a key that with the smallest statistics.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("truth"))
    sample = known.orderBy(F.xxhash64(key), key).limit(sample_rows).select(F.col(key).alias("sampled"), "truth")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    chosen = texts.join(F.broadcast(sample), F.col("key") == F.col("sampled")).select("key", "truth", "text")
    numbers = F.arrow_udf(lambda t: pa.array([statistics(x) for x in _texts(t)], pa.list_(pa.float64())), "array<double>")
    rows = chosen.select("key", "truth", numbers("text").alias("x")).groupBy("key").agg(
        F.min("truth").alias("truth"), F.min("x").alias("x")).select("truth", "x").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the same trees whatever order the rows arrive in
    return grow(x[order], rows["truth"].to_numpy(float)[order])


def score(docs: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with the chance of label 1 added; null text: as the empty text."""

    def run(column: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in _texts(column)], float).reshape(-1, len(FEATURES))
        return pa.array(forest.score(x), pa.float64())

    return docs.withColumn(out, F.arrow_udf(run, "double")(text))
