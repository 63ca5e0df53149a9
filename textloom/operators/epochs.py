"""Gradient descent in epochs with patience.

An epoch is one pass: tasks sum loss and gradient over all their rows, Spark adds
the sums, the driver makes one step of Adam on the weights.  The same pass gives the
loss of the evaluation rows.  The state (weights, moments, best weights, trace) is
saved after every epoch if a path is given, and training goes on from there.  When
the evaluation loss has not fallen for ``patience`` epochs, training stops and the
weights of the best epoch are returned.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Decay of the two moments and the least divisor of the step, as the method's authors recommend.
DECAY, DECAY_SQUARES, LEAST_DIVISOR = 0.9, 0.999, 1e-8


@dataclass
class Training:
    """What an epoch needs of those before it; ``trace`` holds (epoch, train loss, evaluation loss)."""

    weights: list[float]
    moment: list[float]
    squares: list[float]
    best: list[float]
    best_epoch: int = 0
    best_loss: float = float("inf")
    trace: list[tuple[int, float, float]] = field(default_factory=list)

    @staticmethod
    def start(size: int) -> Training:
        zero = [0.0] * size
        return Training(zero, zero, zero, zero)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Training | None:
        """The state of the last epoch saved below ``path``, None without any."""
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return None
        saved = spark.read.text(path).select(F.max(F.struct(F.get_json_object("value", "$.epoch").cast("int"), "value"))).first()[0]
        if saved is None:
            return None
        values = json.loads(saved["value"])["state"]
        return Training(**{**values, "trace": [tuple(t) for t in values["trace"]]})

    def save(self, spark: SparkSession, path: str) -> None:
        line = json.dumps({"epoch": len(self.trace), "state": asdict(self)})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def losses(df: DataFrame, columns: Sequence[str], label: str, held: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``weights``, one model each: (rows, loss) of the parts train and evaluation, gradient of the train loss.

    Sums over all rows, for all models in one pass.  The last weight is the
    intercept.  Rows with a missing value count with the value 0.
    """
    width, models = len(columns), len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((models, 4 + width + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(2 + j).to_numpy(zero_copy_only=False) for j in range(width)] + [np.ones(batch.num_rows)])
            x = np.nan_to_num(x.astype(np.float64))
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            evaluated = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            z = weights @ x.T
            loss = np.logaddexp(0.0, z) - y * z
            error = np.where(evaluated, 0.0, 1.0 / (1.0 + np.exp(-z)) - y)
            sums[:, 0] += (~evaluated).sum()
            sums[:, 1] += loss[:, ~evaluated].sum(axis=1)
            sums[:, 2] += evaluated.sum()
            sums[:, 3] += loss[:, evaluated].sum(axis=1)
            sums[:, 4:] += error @ x
        flat = sums.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    values = [F.col(c).cast("double") for c in columns]
    rows = df.select(F.col(label).cast("double").alias("__y"), F.col(held).alias("__e"), *values)
    # One row per weight, model and task, combined before the shuffle.
    found = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(models * (4 + width + 1))
    for row in found:
        sums[row["i"]] = row["v"]
    sums = sums.reshape(models, -1)
    return sums[:, :4].reshape(models, 2, 2), sums[:, 4:]


def advance(state: Training, sums: np.ndarray, gradient: np.ndarray, rate: float, l2: float) -> None:
    """One epoch: note the losses of the weights before the step, then take the step."""
    train, evaluation = (float(loss / n) if n else float("nan") for n, loss in sums)
    decisive = train if np.isnan(evaluation) else evaluation
    epoch = len(state.trace) + 1
    state.trace.append((epoch, train, evaluation))
    if decisive < state.best_loss:
        state.best, state.best_epoch, state.best_loss = state.weights, epoch, decisive
    weights = np.array(state.weights)
    step = gradient / max(sums[0, 0], 1.0) + l2 * np.append(weights[:-1], 0.0)
    moment = DECAY * np.array(state.moment) + (1 - DECAY) * step
    squares = DECAY_SQUARES * np.array(state.squares) + (1 - DECAY_SQUARES) * step**2
    shift = (moment / (1 - DECAY**epoch)) / (np.sqrt(squares / (1 - DECAY_SQUARES**epoch)) + LEAST_DIVISOR)
    state.weights, state.moment, state.squares = (weights - rate * shift).tolist(), moment.tolist(), squares.tolist()


def train_with_patience(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    held: str,
    epochs: int = 100,
    patience: int = 5,
    rate: float = 0.1,
    l2: float = 0.0,
    path: str | None = None,
) -> Training:
    """Logistic regression on scaled columns; ``held`` is true for evaluation rows.

    ``df`` is read once an epoch, so it should be a written table.  Without evaluation rows the train loss decides.
    """
    spark = df.sparkSession
    state = (Training.load(spark, path) if path else None) or Training.start(len(columns) + 1)
    while len(state.trace) < epochs and len(state.trace) - state.best_epoch <= patience:
        sums, gradients = losses(df, columns, label, held, np.array([state.weights]))
        advance(state, sums[0], gradients[0], rate, l2)
        if path:
            state.save(spark, path)
    return state


def score_with(df: DataFrame, columns: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Add y_score, the probability of label 1, and y_pred."""
    total = F.lit(float(weights[-1]))
    for c, w in zip(columns, weights):
        total = total + F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) * F.lit(float(w))
    score = 1.0 / (1.0 + F.exp(-total))
    return df.withColumn("y_score", score).withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))
