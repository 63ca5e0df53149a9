"""Gradient-boosted trees with a softmax over any number of classes.

Features are binned once; the table of bins, labels and scores is written.  A
round grows one tree per class, all of them level by level: tasks sum gradients
and second derivatives per (class, node, feature, bin) over all their rows, Spark
adds the sums with combining before the shuffle, and the driver, which only ever
sees these sums (their number depends on the model, not on the rows), picks the
splits.  Every row is used in every round.

Scores are carried by the table: after ``refresh`` rounds it is written anew, so a
pass applies at most that many rounds of trees, and the table before it is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from textloom.session import materialize, release

_STATE = "label int, bins binary, scores binary"
_SUMS = "class int, node int, feature int, bin int, g double, h double"


@dataclass(frozen=True)
class Tree:
    """Complete binary tree; node i has the children 2i + 1 and 2i + 2.

    A row goes right if its bin of ``feature`` is above ``cut``; nodes that are not split send all rows left.
    """

    feature: np.ndarray
    cut: np.ndarray
    values: np.ndarray

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Number, within its level, of the node that each row reaches after so many levels."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for level in range(levels):
            node = at + (1 << level) - 1
            feature = self.feature[node]
            right = (feature >= 0) & (bins[rows, np.maximum(feature, 0)] > self.cut[node])
            at = 2 * at + right
        return at

    def score(self, bins: np.ndarray) -> np.ndarray:
        return self.values[self.nodes(bins, (len(self.values) - 1).bit_length())]


@dataclass(frozen=True)
class SoftmaxTrees:
    """A fitted model: edges of the bins by column, scores before the first round, trees by round and class."""

    columns: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def bin(self, values: np.ndarray) -> np.ndarray:
        """Bin 0 for missing values, else 1 + the number of edges below the value."""
        found = np.zeros(values.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            known = ~np.isnan(values[:, j])
            found[known, j] = 1 + np.searchsorted(edges, values[known, j], side="left")
        return found

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                out[:, c] += tree.score(bins)
        return out

    def transform(self, df: DataFrame, out: str = "y_proba") -> DataFrame:
        """Add the probabilities of all classes, as an array of doubles, and ``y_pred``, the first of the likeliest."""
        model, width, names = self, len(self.columns), [*df.columns, out, "y_pred"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                probabilities = softmax(model.scores(model.bin(_matrix(batch, batch.num_columns - width, width))))
                listed = pa.array(probabilities.tolist(), pa.list_(pa.float64()))
                predicted = pa.array(probabilities.argmax(axis=1) if batch.num_rows else [], pa.int32())
                kept = batch.columns[: batch.num_columns - width]
                yield pa.RecordBatch.from_arrays([*kept, listed, predicted], names=names)

        values = [F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(self.columns)]
        added = StructType.fromDDL(f"`{out}` array<double>, y_pred int")
        return df.select("*", *values).mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _matrix(batch: pa.RecordBatch, first: int, width: int) -> np.ndarray:
    columns = [batch.column(first + j).to_numpy(zero_copy_only=False) for j in range(width)]
    return np.column_stack(columns).astype(np.float64) if columns else np.zeros((batch.num_rows, 0))


def _state(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, bins and scores of every batch."""
    for batch in batches:
        if batch.num_rows:
            labels = batch.column(0).to_numpy()
            bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(labels), -1)
            scores = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(len(labels), classes)
            yield labels, bins, scores


def _packed(labels: np.ndarray, bins: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(labels, pa.int32()), *[pa.array([row.tobytes() for row in x], pa.binary()) for x in (bins, scores)]]
    return pa.RecordBatch.from_arrays(columns, names=["label", "bins", "scores"])


def with_bins(df: DataFrame, label: str, model: SoftmaxTrees) -> DataFrame:
    """The state before the first round."""
    width = len(model.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = model.bin(_matrix(batch, 1, width))
                yield _packed(batch.column(0).to_numpy(), bins, np.tile(model.base, (len(bins), 1)))

    values = [F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(model.columns)]
    return df.select(F.col(label).cast("int").alias("__label"), *values).mapInArrow(run, _STATE)


def with_rounds(state: DataFrame, classes: int, rounds: Sequence[Sequence[Tree]]) -> DataFrame:
    """The state after these rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, bins, scores in _state(batches, classes):
            yield _packed(labels, bins, _advanced(bins, scores, rounds))

    return state.mapInArrow(run, _STATE)


def _advanced(bins: np.ndarray, scores: np.ndarray, rounds: Sequence[Sequence[Tree]]) -> np.ndarray:
    scores = scores.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            scores[:, c] += tree.score(bins)
    return scores


def gradient_sums(state: DataFrame, classes: int, bins: int, rounds: Sequence[Sequence[Tree]], grown: Sequence[Tree], level: int) -> DataFrame:
    """Sums of gradients and second derivatives per (class, node of the level, feature, bin) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for labels, binned, scores in _state(batches, classes):
            width = binned.shape[1]
            if sums is None:
                sums = np.zeros((2, classes, (1 << level) * width * bins))
            shares = softmax(_advanced(binned, scores, rounds))
            for c in range(classes):
                node = grown[c].nodes(binned, level)
                cell = ((node[:, None] * width + np.arange(width)) * bins + binned).ravel()
                for i, value in enumerate((shares[:, c] - (labels == c), shares[:, c] * (1.0 - shares[:, c]))):
                    sums[i, c] += np.bincount(cell, np.repeat(value, width), sums.shape[2])
        if sums is not None:
            c, cell = np.nonzero((sums != 0).any(axis=0))
            columns = [
                pa.array(c, pa.int32()),
                pa.array(cell // (width * bins), pa.int32()),
                pa.array(cell // bins % width, pa.int32()),
                pa.array(cell % bins, pa.int32()),
                pa.array(sums[0][c, cell]),
                pa.array(sums[1][c, cell]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "node", "feature", "bin", "g", "h"])

    rows = state.mapInArrow(run, _SUMS)
    return rows.groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_split(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[int, int]:
    """(feature, cut) with the largest gain, (-1, 0) if none gains; g and h by feature and bin; ties go to the first."""
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    all_g, all_h = g[:1].sum(), h[:1].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
    gain = np.where((left_h >= least) & (right_h >= least), np.round(gain, 9), 0.0)
    best = int(gain.argmax())
    return divmod(best, gain.shape[1]) if gain.flat[best] > 0 else (-1, 0)


def fit_softmax_trees(
    df: DataFrame,
    columns: Sequence[str],
    classes: int,
    label: str = "label",
    rounds: int = 400,
    depth: int = 6,
    rate: float = 0.05,
    bins: int = 64,
    l2: float = 1.0,
    least: float = 1.0,
    refresh: int = 20,
) -> SoftmaxTrees:
    """Fit on all rows with a label from 0 to ``classes`` - 1; at most 254 bins.

    Missing values have a bin of their own, below all others.  Bins hold about
    equally many rows; their edges are approximate quantiles over all rows.
    """
    rows = df.where(F.col(label).between(0, classes - 1))
    n = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}  # one row per class
    if not n:
        raise ValueError("there are no labelled rows")
    share = [i / (bins - 1) for i in range(1, bins - 1)]
    quantiles = rows.agg(
        *[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), share, 10_000).alias(f"q{i}") for i, c in enumerate(columns)]
    ).first()
    edges = [np.unique(np.array(quantiles[f"q{i}"] or [], np.float64)) for i in range(len(columns))]
    base = np.log(np.array([max(n.get(c, 0), 0.5) for c in range(classes)], np.float64) / sum(n.values()))
    model = SoftmaxTrees(list(columns), edges, base)
    state = materialize(with_bins(rows, label, model), "boosting")
    done = 0  # rounds that the scores of the state hold
    for number in range(rounds):
        inner = (1 << depth) - 1
        grown = [Tree(np.full(inner, -1, np.int64), np.zeros(inner, np.int64), np.zeros(1 << depth)) for _ in range(classes)]
        for level in range(depth):
            sums = np.zeros((2, classes, 1 << level, len(columns), bins + 1))
            found = gradient_sums(state, classes, bins + 1, model.rounds[done:], grown, level).toArrow()
            where = tuple(found.column(c).to_numpy() for c in ("class", "node", "feature", "bin"))
            for i, name in enumerate("gh"):
                sums[(i, *where)] = found.column(name).to_numpy()
            for c in range(classes):
                for node in range(1 << level):
                    g, h = sums[0, c, node], sums[1, c, node]
                    feature, cut = best_split(g, h, l2, least)
                    at = (1 << level) - 1 + node
                    grown[c].feature[at], grown[c].cut[at] = feature, cut
                    if level == depth - 1:
                        row = max(feature, 0)
                        cut_g, cut_h = (x[row, : cut + 1].sum() if feature >= 0 else x[row].sum() for x in (g, h))
                        rest_g, rest_h = g[row].sum() - cut_g, h[row].sum() - cut_h
                        grown[c].values[2 * node] = -rate * cut_g / (cut_h + l2)
                        grown[c].values[2 * node + 1] = -rate * rest_g / (rest_h + l2) if feature >= 0 else 0.0
        model.rounds.append(grown)
        if number + 1 - done == refresh and number + 1 < rounds:
            older, state = state, materialize(with_rounds(state, classes, model.rounds[done:]), "boosting")
            release(older)
            done = number + 1
    release(state)
    return model
