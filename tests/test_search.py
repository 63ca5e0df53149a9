"""Adaptive search on objectives with a known best point, and on logistic regressions."""

import math

import numpy as np
from textloom.operators import epochs, search as sr

SPACE = {"x": sr.Range(0.0, 10.0), "y": sr.Range(1e-4, 1.0, log=True)}


def bowl(trials, budget):
    """Best at x = 7, y = 0.01; larger budgets say it more exactly."""
    return [(p["x"] - 7) ** 2 / 10 + math.log10(p["y"] / 0.01) ** 2 + 1 / budget for _, p in trials]


def test_finds_a_better_point_than_the_first_draws(spark):
    done = sr.search(spark, SPACE, bowl, trials=60, bracket=12)
    best = sr.best_trial(done)
    first = min(t.score for t in done if t.trial < 12 and t.rung == 0)
    assert best.score < first and best.score < 0.2 and best.budget == 36


def test_weak_trials_stop(spark):
    done = sr.search(spark, SPACE, bowl, trials=20, bracket=10, budgets=(1, 3, 9), keep=0.3)
    for start in (0, 10):
        rungs = [[t for t in done if t.rung == r and start <= t.trial < start + 10] for r in range(3)]
        assert [len(r) for r in rungs] == [10, 3, 1]
        assert {t.trial for t in rungs[1]} == {t.trial for t in sorted(rungs[0], key=lambda t: t.score)[:3]}


def test_reruns_agree_and_a_stopped_search_goes_on(spark, tmp_path):
    whole = sr.search(spark, SPACE, bowl, trials=30, bracket=10)
    path, calls = str(tmp_path / "trials"), []

    def failing(trials, budget):
        calls.append(len(trials))
        if len(calls) == 5:
            raise RuntimeError("lost")
        return bowl(trials, budget)

    try:
        sr.search(spark, SPACE, failing, trials=30, bracket=10, path=path)
    except RuntimeError:
        pass
    again = sr.search(spark, SPACE, failing, trials=30, bracket=10, path=path)
    assert len(calls) == 10  # nine rungs, one of them twice
    for one, other in zip(whole, again):
        assert (one.trial, one.rung, one.budget) == (other.trial, other.rung, other.budget)
        assert math.isclose(one.score, other.score) and all(math.isclose(one.params[k], other.params[k]) for k in SPACE)


def test_scores_that_are_not_finite_are_the_worst(spark):
    done = sr.search(spark, SPACE, lambda t, b: [math.nan if n % 2 else 1.0 for n, _ in t], trials=6, bracket=6, budgets=(1, 2), keep=0.5)
    assert all(t.trial % 2 == 0 for t in done if t.rung == 1)


def test_ranges_go_back_and_forth():
    for r in SPACE.values():
        for u in (0.0, 0.3, 1.0):
            assert math.isclose(r.share(r.at(u)), u, abs_tol=1e-12)


def test_a_rung_is_trained_in_one_pass(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    rows = [(float(a), float(b), int(a + b > 0), i % 3 == 0) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, label int, held boolean")
    objective = sr.logistic_objective(df, ["a", "b"], "label", "held")
    trials = [(0, {"rate": 0.1, "l2": 0.0}), (1, {"rate": 0.5, "l2": 0.01})]
    objective(trials, 2)
    together = objective(trials, 4)
    for (_, params), loss in zip(trials, together):
        alone = epochs.train_with_patience(df, ["a", "b"], "label", "held", epochs=4, patience=9, **params)
        assert math.isclose(alone.best_loss, loss)
