"""Kernels over sequences and training with patience against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from textloom.operators import convolution as cv, epochs, models as md


def plain_pooled(matrix, dilations):
    n, layers = len(matrix), len(matrix[0]) if matrix else 3
    out = []
    for layer in range(layers):
        for dilation in dilations:
            for pair in cv.KERNELS:
                values = []
                for i in range(n):
                    total = 0.0
                    for k in range(cv.TAPS):
                        at = i + (k - cv.TAPS // 2) * dilation
                        if 0 <= at < n:
                            total += (2.0 if k in pair else -1.0) * matrix[at][layer]
                    values.append(total)
                out += [max(values), sum(v > 1e-12 for v in values) / n] if n else [0.0, 0.0]
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_pooled_values_equal_plain_loops(n):
    rng = np.random.default_rng(n)
    matrix = rng.normal(size=(n, 3))
    got = cv.pooled(matrix, (1, 2, 8))
    assert len(got) == cv.feature_count(3, (1, 2, 8))
    assert np.allclose(got, plain_pooled(matrix.tolist(), (1, 2, 8)))


def test_kernels_of_matrices(spark):
    """Missing values count as the mean, a null matrix has no positions, long sequences are read whole."""
    rng = np.random.default_rng(1)
    long = rng.uniform(0.01, 1, size=(30_000, 2)).tolist()
    rows = [(1, [[0.5, None], [0.1, 0.2], [0.9, 0.3]]), (2, None), (3, []), (4, long)]
    df = spark.createDataFrame(rows, "doc_id int, m array<array<double>>")
    found = {r["doc_id"]: r["kernels"] for r in cv.with_pooled_kernels(df, "m", [-1.0, -2.0], [0.5, 0.0]).collect()}
    for key, matrix in rows:
        logs = [[0.0 if p is None else (math.log(p) - m) / s for p, m, s in zip(row, (-1.0, -2.0), (0.5, 1.0))] for row in matrix or []]
        if key == 4:
            logs = np.array(logs)
            assert np.allclose(found[key], cv.pooled(logs))
            continue
        want = plain_pooled(logs, cv.DILATIONS) if logs else [0.0] * cv.feature_count(2)
        assert np.allclose(found[key], want)


def table_of(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] - 2 * x[:, 1] + rng.normal(size=n) > 0).astype(int)
    held = np.arange(n) % 4 == 0
    rows = [(float(a), float(b), int(c), bool(d)) for (a, b), c, d in zip(x, y, held)]
    return spark.createDataFrame(rows, "a double, b double, label int, held boolean"), x, y, held


def plain_training(x, y, held, epochs_, patience, rate):
    x = np.column_stack([x, np.ones(len(x))])
    w = m = v = np.zeros(3)
    best, best_epoch, best_loss, trace = w, 0, np.inf, []
    while len(trace) < epochs_ and len(trace) - best_epoch <= patience:
        z = x @ w
        loss = np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z
        trace.append((loss[~held].mean(), loss[held].mean()))
        t = len(trace)
        if trace[-1][1] < best_loss:
            best, best_epoch, best_loss = w, t, trace[-1][1]
        g = ((1 / (1 + np.exp(-z)) - y)[~held] @ x[~held]) / (~held).sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return best, best_epoch, trace


def test_training_stops_and_returns_the_best(spark):
    df, x, y, held = table_of(spark)
    found = epochs.train_with_patience(df, ["a", "b"], "label", "held", epochs=60, patience=3, rate=0.8)
    best, best_epoch, trace = plain_training(x, y, held, 60, 3, 0.8)
    assert found.best_epoch == best_epoch and len(found.trace) == len(trace) == best_epoch + 4 < 60
    assert np.allclose([t[1:] for t in found.trace], trace) and np.allclose(found.best, best)
    scored = epochs.score_with(df, ["a", "b"], found.best)
    assert scored.where(F.col("y_pred") == F.col("label")).count() > 0.8 * len(y)


def test_training_goes_on_where_it_stopped(spark, tmp_path):
    df, *_ = table_of(spark)
    path = str(tmp_path / "state")
    epochs.train_with_patience(df, ["a", "b"], "label", "held", epochs=4, path=path)
    resumed = epochs.train_with_patience(df, ["a", "b"], "label", "held", epochs=7, path=path)
    whole = epochs.train_with_patience(df, ["a", "b"], "label", "held", epochs=7)
    assert len(resumed.trace) == 7 and np.allclose(resumed.trace, whole.trace) and np.allclose(resumed.weights, whole.weights)


def test_no_evaluation_rows(spark):
    df, *_ = table_of(spark, 40)
    found = epochs.train_with_patience(df.withColumn("held", F.lit(False)), ["a"], "label", "held", epochs=3)
    assert found.best_epoch == 3 and all(math.isnan(t[2]) for t in found.trace)


def test_every_model_on_every_data_set(spark):
    """Two data sets with opposite labels: a model is right on its own and wrong on the other."""
    rng = np.random.default_rng(5)
    rows = [(name, float(x), int((x > 0) == (name == "up")), i % 4 == 0) for name in ("up", "down") for i, x in enumerate(rng.normal(size=200))]
    rows += [("single", 1.0, 1, False)] * 5 + [("single", -1.0, 0, True)] * 5
    df = spark.createDataFrame(rows, "name string, x double, label int, held boolean")
    found = {(r["model"], r["dataset"]): r for r in md.cross_evaluate(df, "name", "held", md.logistic(["x"])).collect()}
    assert set(found) == {(m, d) for m in ("up", "down") for d in ("up", "down", "single")}
    assert found["up", "up"]["accuracy"] > 0.9 and found["up", "down"]["accuracy"] < 0.1 and found["down", "down"]["roc_auc"] > 0.9
    with pytest.raises(ValueError):
        md.cross_evaluate(df, "name", "held", md.logistic(["x"]), most=1)
