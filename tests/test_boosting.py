"""Softmax boosting against a plain version on a small table."""

import numpy as np
import pytest
from textloom.operators import boosting

COLUMNS = ["x", "y", "z"]


def table_of(spark, n=600, seed=7):
    rng = np.random.default_rng(seed)
    x, y, z = rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.normal(size=n)
    label = np.where(x + 0.3 * y > 1, 2, np.where(z * x > 0, 1, 0))
    rows = [
        (None if i % 17 == 0 else float(x[i]), float("nan") if i % 23 == 0 else float(y[i]), float(z[i]), int(label[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "x double, y double, z double, label int").repartition(5), rows


def plain_fit(bins, labels, classes, rounds, depth, rate, l2, least, base):
    """Boosting by plain loops over nodes, features and cuts."""
    scores = np.tile(base, (len(bins), 1))
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        step = np.zeros_like(scores)
        for c in range(classes):
            g, h = p[:, c] - (labels == c), p[:, c] * (1 - p[:, c])

            def grow(rows, level):
                G, H = g[rows].sum(), h[rows].sum()
                best = (0.0, None)
                if level < depth:
                    for f in range(bins.shape[1]):
                        for cut in range(int(bins[:, f].max())):
                            left = rows & (bins[:, f] <= cut)
                            right = rows & ~left
                            if h[left].sum() >= least and h[right].sum() >= least:
                                gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, right)) - G**2 / (H + l2)
                                if round(gain, 9) > best[0]:
                                    best = (round(gain, 9), (left, right))
                if best[1] is None:
                    step[rows, c] = -rate * G / (H + l2)
                else:
                    for part in best[1]:
                        grow(part, level + 1)

            grow(np.ones(len(bins), bool), 0)
        scores = scores + step
    return np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)


@pytest.mark.parametrize("depth, refresh", [(1, 100), (3, 2)])
def test_equals_plain_version(spark, depth, refresh):
    df, rows = table_of(spark)
    model = boosting.fit_softmax_trees(df, COLUMNS, 3, rounds=5, depth=depth, rate=0.3, bins=12, refresh=refresh)
    values = np.array([[np.nan if v is None else v for v in r[:3]] for r in rows])
    labels = np.array([r[3] for r in rows])
    wanted = plain_fit(model.bin(values), labels, 3, 5, depth, 0.3, 1.0, 1.0, model.base)
    got = {r["i"]: r["y_proba"] for r in model.transform(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x double, y double, z double, label int")).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], wanted, atol=1e-9)


def test_learns_and_predicts(spark):
    df, _ = table_of(spark, 1500)
    test, _ = table_of(spark, 500, seed=8)
    model = boosting.fit_softmax_trees(df, COLUMNS, 3, rounds=25, depth=3, rate=0.3, bins=32)
    found = model.transform(test).collect()
    assert sum(r["label"] == r["y_pred"] for r in found) > 0.85 * len(found)
    assert all(abs(sum(r["y_proba"]) - 1) < 1e-9 for r in found)


def test_absent_classes_constant_columns_and_no_rows(spark):
    rows = [(1.0, None, 0)] * 20 + [(1.0, None, 2)] * 10
    df = spark.createDataFrame(rows, "x double, y double, label int")
    model = boosting.fit_softmax_trees(df, ["x", "y"], 4, rounds=2, depth=2)
    got = model.transform(df).collect()
    assert {r["y_pred"] for r in got} == {0} and got[0]["y_proba"][1] < 0.05
    assert model.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        boosting.fit_softmax_trees(df.where("label > 5"), ["x"], 2)
