"""Quality classifier: gradient-boosted trees over statistics of whole texts.

Statistics are cut into at most ``BINS`` bins once; every tree is grown level
by level from sums of gradients per (node, bin).  A trained model is four flat
arrays; a batch of rows is scored by stepping all rows through all trees
together.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import map_texts
from textloom.session import materialize

FEATURES = (
    "words (log)",
    "bytes per word",
    "symbols per word",
    "capitals per byte",
    "digits per byte",
    "exclamation and question marks per word",
    "full stops and commas per word",
    "distinct words",
    "words equal to the one before",
    "repeated lines",
    "words per line (log)",
    "lines with a closing mark",
    "bytes outside ASCII",
    "words of one character",
)
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]

#: Labelled rows used for fitting, at most; taken in the order of a hash of the id.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_WEIGHT, RIDGE = 64, 80, 4, 0.15, 5.0, 1.0


def statistics(raw: bytes) -> list[float]:
    """The features of one whole text; zeros for a text without words."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [line.strip() for line in raw.split(b"\n")]
    lines = [line for line in lines if line]
    size = len(raw)
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        float(counts[_SYMBOLS].sum()) / n,
        float(counts[65:91].sum()) / size,
        float(counts[48:58].sum()) / size,
        float(counts[33] + counts[63]) / n,
        float(counts[46] + counts[44]) / n,
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        (len(lines) - len(set(lines))) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(line.endswith((b".", b"!", b"?")) for line in lines) / len(lines),
        float(counts[128:].sum()) / size,
        sum(len(w) == 1 for w in words) / n,
    ]


@dataclass
class Forest:
    """Trees of equal depth: children of node i are 2 i + 1 and 2 i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; larger values go right
    leaf: np.ndarray  # trees x leaves

    def raw(self, rows: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(rows), len(self.feature)), np.int64)
        at = np.arange(len(rows))[:, None]
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        depth = int(np.log2(inner + 1)) if inner else 0
        for _ in range(depth):
            value = rows[at, self.feature[trees, node]]
            node = 2 * node + 1 + (value > self.threshold[trees, node])
        if not len(self.feature):
            return np.full(len(rows), self.base)
        return self.base + self.leaf[trees, node - inner].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1.0 / (1.0 + np.exp(-self.raw(rows)))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees for labels 0 and 1.

    With a single label, or none at all, the forest has no trees and scores
    the share of ones, smoothed by one row of each label.
    """
    ones = (labels.sum() + 1.0) / (len(labels) + 2.0)
    base = float(np.log(ones / (1.0 - ones)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(np.unique(labels)) < 2:
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n_features = rows.shape[1]
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(c, rows[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    all_features, all_thresholds, all_leaves = [], [], []
    raw = np.full(len(rows), base)
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        slope, weight = labels - p, p * (1.0 - p)
        node = np.zeros(len(rows), np.int64)  # within its level
        features, thresholds = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width = 2**level
            best = np.zeros(width)
            chosen, limit = np.zeros(width, np.int64), np.full(width, BINS, np.int64)
            total_s, total_w = np.bincount(node, slope, width), np.bincount(node, weight, width)
            whole = total_s**2 / (total_w + RIDGE)
            for j in range(n_features):
                cell = node * BINS + binned[:, j]
                left_s = np.bincount(cell, slope, width * BINS).reshape(width, BINS).cumsum(axis=1)
                left_w = np.bincount(cell, weight, width * BINS).reshape(width, BINS).cumsum(axis=1)
                right_s, right_w = total_s[:, None] - left_s, total_w[:, None] - left_w
                gain = left_s**2 / (left_w + RIDGE) + right_s**2 / (right_w + RIDGE) - whole[:, None]
                gain[(left_w < LEAST_WEIGHT * 0.1) | (right_w < LEAST_WEIGHT * 0.1)] = 0.0
                gain[:, len(cuts[j]) :] = 0.0
                at = gain.argmax(axis=1)
                found = gain[np.arange(width), at]
                better = found > best + 1e-12
                best[better], chosen[better], limit[better] = found[better], j, at[better]
            for k in range(width):
                features[width - 1 + k] = chosen[k]
                if limit[k] < BINS:
                    thresholds[width - 1 + k] = cuts[chosen[k]][limit[k]]
            node = 2 * node + (binned[np.arange(len(rows)), chosen[node]] > limit[node])
        leaf = RATE * np.bincount(node, slope, leaves) / (np.bincount(node, weight, leaves) + RIDGE)
        raw += leaf[node]
        all_features.append(features)
        all_thresholds.append(thresholds)
        all_leaves.append(leaf)
    return Forest(base, np.stack(all_features), np.stack(all_thresholds), np.stack(all_leaves))


def held_out(key: Column) -> Column:
    """Rows whose crc32 of the id, as text, is divisible by five are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and features of every whole text; one pass, no shuffle."""
    return map_texts(docs, text, [key], "features array<double>", lambda ts: {"features": [statistics(t or b"") for t in ts]})


def train(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", limit: int = TRAIN_ROWS) -> Forest:
    """Fit on at most ``limit`` labelled rows that are not held out.

    Rows with a null id or a label other than 0 and 1 are left out; an id with
    several labels gives several rows.  Only the bounded sample reaches the driver.
    """
    usable = labels.select(F.col(key), F.col(label).cast("int").alias("__y")).where(
        F.col(key).isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col(key))
    )
    sample = usable.orderBy(F.xxhash64(key), key, "__y").limit(limit)
    rows = sample.join(features, key).orderBy(key, "__y", "features").limit(limit).select("__y", "features").collect()
    if not rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array([r.features for r in rows]), np.array([r["__y"] for r in rows], dtype=float))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    threshold: float = 0.3,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """Key, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Every row gets a score from its whole text alone; null and empty texts have
    all features 0, rows with a null id count as not held out but have no label.
    Texts are read once: the features are written and used for fitting and
    scoring.  Without usable labels every score is 0.5.
    """
    features = materialize(with_statistics(docs, key, text), "statistics")
    forest = train(features, labels, key, label, train_rows)

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.stack(rows.to_numpy())) if len(rows) else [], dtype=float)

    return features.select(key, held_out(F.col(key)).alias("held_out"), score("features").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
