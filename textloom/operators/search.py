"""Adaptive search for parameters: proposals by two densities, weak trials halved.

A bracket is a batch of trials.  All of them get a small budget; the best part goes
on with a larger one, and so on (successive halving).  New trials are proposed where
the density of the good trials so far is largest against that of the others (Bergstra
et al., Algorithms for Hyper-Parameter Optimization, 2011).  A rung, all trials with
one budget, is evaluated together, so an objective can give all of them one pass over
the data.

Finished rungs are appended to a trial table; a search that is started again with the
table repeats none of them.  Draws depend on the seed and the trial's number only, so
reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from textloom.operators import epochs

TRIALS = "trial int, rung int, budget int, params map<string,double>, score double"
#: Share of trials that count as good, candidates per proposal, trials before densities are used.
GOOD, CANDIDATES, FIRST = 0.25, 32, 8


@dataclass(frozen=True)
class Range:
    """Values from ``low`` to ``high``, evenly or, for ``log``, evenly by order of magnitude."""

    low: float
    high: float
    log: bool = False

    def at(self, share: float) -> float:
        low, high = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        value = low + float(share) * (high - low)
        return math.exp(value) if self.log else value

    def share(self, value: float) -> float:
        low, high, value = (math.log(x) if self.log else x for x in (self.low, self.high, value))
        return (value - low) / (high - low) if high > low else 0.0


@dataclass(frozen=True)
class Trial:
    trial: int
    rung: int
    budget: int
    params: dict[str, float]
    score: float


def density(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Kernel density on [0, 1] by column, with one even part; points and places as rows."""
    width = max(1.0 / (len(points) + 1), 0.05)
    gaps = (at[:, None, :] - points[None, :, :]) / width
    kernels = np.exp(-0.5 * gaps**2) / (width * math.sqrt(2 * math.pi))
    return (kernels.sum(axis=1) + 1.0) / (len(points) + 1)


def propose(space: Mapping[str, Range], done: Sequence[Trial], number: int, seed: int) -> dict[str, float]:
    """Parameters of trial ``number``, from the scores of the trials before (smaller is better)."""
    rng = np.random.default_rng([seed, number])
    names = sorted(space)
    if len(done) < FIRST:
        return {name: space[name].at(u) for name, u in zip(names, rng.random(len(names)))}
    # A trial counts with its last rung; trials that went further rank before those that were halved away.
    last = {t.trial: t for t in sorted(done, key=lambda t: t.rung)}
    ranked = sorted(last.values(), key=lambda t: (-t.rung, t.score, t.trial))
    points = np.array([[space[n].share(t.params[n]) for n in names] for t in ranked])
    cut = max(2, math.ceil(GOOD * len(ranked)))
    good, rest = points[:cut], points[cut:]
    width = max(1.0 / (len(good) + 1), 0.05)
    centres = good[rng.integers(0, len(good), CANDIDATES)]
    drawn = np.clip(centres + width * rng.normal(size=centres.shape), 0.0, 1.0)
    ratio = (np.log(density(good, drawn)) - np.log(density(rest, drawn))).sum(axis=1)
    return {name: space[name].at(u) for name, u in zip(names, drawn[int(ratio.argmax())])}


def read_trials(spark: SparkSession, path: str) -> list[Trial]:
    """Finished trials, one row per trial and rung; their number is the search's, not the data's."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return []
    return [Trial(*row) for row in spark.read.schema(TRIALS).json(path).collect()]


def search(
    spark: SparkSession,
    space: Mapping[str, Range],
    objective: Callable[[list[tuple[int, dict[str, float]]], int], list[float]],
    trials: int = 50,
    bracket: int = 10,
    budgets: Sequence[int] = (4, 12, 36),
    keep: float = 1 / 3,
    seed: int = 0,
    path: str | None = None,
) -> list[Trial]:
    """All rungs of all trials.

    ``objective`` gets (number, parameters) of the trials of a rung and the
    budget, and returns their scores, smaller is better; one that is not finite
    counts as the worst.
    """
    done = read_trials(spark, path) if path else []
    for first in range(0, trials, bracket):
        numbers = range(first, min(first + bracket, trials))
        before = [t for t in done if t.trial < first]
        known = {t.trial: t.params for t in done}
        going = {n: known.get(n) or propose(space, before, n, seed) for n in numbers}
        for rung, budget in enumerate(budgets):
            found = {t.trial: t for t in done if t.rung == rung and t.trial in going}
            open_ = [(n, params) for n, params in going.items() if n not in found]
            if open_:
                scores = objective(open_, budget)
                new = [
                    Trial(n, rung, budget, params, float(s) if math.isfinite(s) else math.inf)
                    for (n, params), s in zip(open_, scores)
                ]
                if path:
                    rows = [(t.trial, t.rung, t.budget, t.params, min(t.score, 1e308)) for t in new]
                    spark.createDataFrame(rows, TRIALS).coalesce(1).write.mode("append").json(path)
                done += new
                found |= {t.trial: t for t in new}
            best = sorted(found.values(), key=lambda t: (t.score, t.trial))[: max(1, math.ceil(keep * len(found)))]
            going = {t.trial: going[t.trial] for t in best}
    return sorted(done, key=lambda t: (t.trial, t.rung))


def best_trial(done: Sequence[Trial]) -> Trial:
    """Smallest score among the trials with the largest budget."""
    most = max(t.budget for t in done)
    return min((t for t in done if t.budget == most), key=lambda t: (t.score, t.trial))


def logistic_objective(df: DataFrame, columns: Sequence[str], label: str, held: str):
    """Evaluation loss of logistic regressions with parameters ``rate`` and ``l2`` after ``budget`` epochs.

    An epoch of a whole rung is one pass; trials that go on start where they were.
    """
    states: dict[int, epochs.Training] = {}

    def run(trials: list[tuple[int, dict[str, float]]], budget: int) -> list[float]:
        going = [states.setdefault(n, epochs.Training.start(len(columns) + 1)) for n, _ in trials]
        while any(len(s.trace) < budget for s in going):
            sums, gradients = epochs.losses(df, columns, label, held, np.array([s.weights for s in going]))
            for state, (_, params), total, gradient in zip(going, trials, sums, gradients):
                if len(state.trace) < budget:
                    epochs.advance(state, total, gradient, params["rate"], params["l2"])
        return [s.best_loss for s in going]

    return run
