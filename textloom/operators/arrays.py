"""Array-valued features: order, padding, augmentation, spectra."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def sort_arrays_by(
    df: DataFrame, by: str, *columns: str, reverse: bool = False, include_by: bool = True
) -> DataFrame:
    """Reorder arrays of each row by the values of ``by``; all must have the
    same length (a differing row raises).  ``include_by=False`` leaves ``by``
    itself as it is."""
    names = list(dict.fromkeys([by, *columns]))
    size = F.size(by)
    uneven = F.lit(False)
    for c in names:
        uneven = uneven | (F.size(c) != size)
    entries = F.transform(
        F.arrays_zip(*names),
        lambda e, i: F.struct(e[by].alias("__key"), i.alias("__i"), *[e[c].alias(c) for c in names]),
    )
    ordered = F.sort_array(entries, asc=not reverse)
    checked = F.when(uneven, F.raise_error(F.lit(f"arrays differ in length from {by}"))).otherwise(ordered)
    moved = [c for c in names if include_by or c != by or by in columns]
    staged = df.withColumn("__sorted", checked)
    return staged.withColumns({c: F.col("__sorted").getField(c) for c in moved}).drop("__sorted")


def pad_or_trim(values: Column, length: int, pad: Column) -> Column:
    """Exactly ``length`` entries: cut, or filled with ``pad`` at the end."""
    return F.slice(F.concat(values, F.array_repeat(pad, length)), 1, length)


def padding_mask(values: Column, length: int) -> Column:
    """True for entries that come from the data."""
    n = F.size(values)
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= n)


def nan_to_num(x: Column) -> Column:
    """NaN to 0, infinities to +-1."""
    return (
        F.when(F.isnan(x), 0.0).when(x == float("inf"), 1.0).when(x == float("-inf"), -1.0).otherwise(x)
    )


def rescale(x: Column) -> Column:
    """[0, 1] to [-1, 1]."""
    return x * 2 - 1


def augment_layers(layers: Column, delta: bool = False, product: bool = False) -> Column:
    """Append (others - first) or (others * first); n layers become 2n - 1."""
    if delta and product:
        raise ValueError("choose delta or product, not both")
    if not (delta or product):
        return layers
    first = F.get(layers, F.lit(0))
    others = F.slice(layers, 2, F.greatest(F.size(layers) - 1, F.lit(0)))
    added = F.transform(others, (lambda x: x - first) if delta else (lambda x: x * first))
    return F.concat(layers, added)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``; inside a lambda a plain
    expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    """Stable softmax of an array."""
    exps = let(
        F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top))
    )

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.transform(e, lambda x: x / t))

    return let(exps, shares)


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def min_max_scores(df: DataFrame, score: str) -> DataFrame:
    """Rescale a score to [0, 1], only when some value lies outside."""
    bounds = df.agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    outside = (F.col("__low") < 0) | (F.col("__high") > 1)
    scaled = (F.col(score) - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))
    joined = df.crossJoin(F.broadcast(bounds))  # exactly one row
    return joined.withColumn(score, F.when(outside, scaled).otherwise(F.col(score))).drop(
        "__low", "__high"
    )


def mean_pool(df: DataFrame, key: str, vector: str, mask: Column) -> DataFrame:
    """(key, dim, value): masked mean per dimension.  The rows of a key are
    partially summed before the shuffle, so a hot key costs no more."""
    masked = df.select(key, mask.cast("double").alias("m"), F.col(vector).alias("v"))
    spread = masked.select(key, "m", F.posexplode("v").alias("dim", "x"))
    total = F.sum(F.col("x").cast("double") * F.col("m"))
    return spread.groupBy(key, "dim").agg(
        (total / F.greatest(F.sum("m"), F.lit(1e-9))).alias("value")
    )


def split_feature_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Halve the list columns into two rows with keys ``<key>.0`` and ``<key>.1``."""

    def half(column: str) -> Column:
        middle = F.floor(F.size(column) / 2).cast("int")
        return F.when(F.col("__half") == 0, F.slice(column, F.lit(1), middle)).otherwise(
            F.slice(column, middle + 1, F.size(column) - middle)
        )

    doubled = df.withColumn("__half", F.explode(F.array(F.lit(0), F.lit(1))))
    out = [c for c in df.columns if c not in {key, *columns}]
    return doubled.select(
        F.concat_ws(".", F.col(key), F.col("__half")).alias(key),
        *out,
        *[half(c).alias(c) for c in columns],
    )


def zip_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parallel arrays -> one row per position."""
    rest = [c for c in df.columns if c not in columns]
    zipped = df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("pos", "item"))
    return zipped.select(*rest, "pos", "item.*")


def merge_features(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Concatenate the arrays of a document's pieces in order; together they
    are one document's features, so the result fits a row."""
    pieces = F.sort_array(F.collect_list(F.struct(order, *columns)))
    return df.groupBy(key).agg(pieces.alias("p")).select(
        key, *[F.flatten(F.col("p").getField(c)).alias(c) for c in columns]
    )


def trajectory_spectrum(df: DataFrame, key: str, matrix: str) -> DataFrame:
    """(key, frequency, power) of the mean-over-layers series of each row,
    without the constant part.  Only the means go to Python, in Arrow batches;
    nothing is shuffled.  A NULL or empty matrix has no spectrum."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    series = F.transform(matrix, lambda v: F.try_divide(total(v), F.size(v)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, frequencies, powers = [], [], []
            for k, series in zip(batch[key], batch["__series"]):
                power = np.abs(np.fft.rfft(series - series.mean())) ** 2
                keys.append(np.repeat(k, len(power) - 1))
                frequencies.append(np.fft.rfftfreq(len(series))[1:])
                powers.append(power[1:])
            if keys:
                yield pd.DataFrame(
                    {
                        key: np.concatenate(keys),
                        "frequency": np.concatenate(frequencies),
                        "power": np.concatenate(powers),
                    }
                )

    kind = df.schema[key].dataType.simpleString()
    means = df.where(F.size(matrix) > 0).select(key, series.alias("__series"))
    return means.mapInPandas(run, f"{key} {kind}, frequency double, power double")
