"""Convolution over token sequences with a fixed bank of dilated kernels.

A kernel has ``TAPS`` taps, two of weight 2 and the others of weight -1, so its
weights sum to 0 (kernels of this kind: Dempster, Schmidt and Webb, MiniRocket,
2021).  Every kernel runs with every dilation over every layer of a likelihood
matrix, whatever its length, and is pooled to its maximum and its share of positive
values; a linear model follows.  There is nothing to learn but the mean and
deviation of each layer, so features are one pass in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

TAPS = 6
DILATIONS = (1, 2, 4, 8, 16, 32)
#: Places of the two taps of weight 2.
KERNELS = tuple(combinations(range(TAPS), 2))


def feature_count(layers: int, dilations: Sequence[int] = DILATIONS) -> int:
    return 2 * layers * len(dilations) * len(KERNELS)


def pooled(matrix: np.ndarray, dilations: Sequence[int] = DILATIONS) -> np.ndarray:
    """Maximum and share of positives by (layer, dilation, kernel) of a positions by layers matrix.

    Positions beyond the ends count as 0; without positions everything is 0.
    """
    n, layers = matrix.shape
    out = np.zeros((layers, len(dilations), len(KERNELS), 2))
    if not n:
        return out.ravel()
    for d, dilation in enumerate(dilations):
        # Tap k of the output at position i reads position i + (k - TAPS // 2) * dilation.
        reach = (TAPS // 2) * dilation
        wide = np.zeros((n + 2 * reach, layers))
        wide[reach : reach + n] = matrix
        taps = [wide[k * dilation : k * dilation + n] for k in range(TAPS)]
        total = np.sum(taps, axis=0)
        for j, (a, b) in enumerate(KERNELS):
            values = 3.0 * (taps[a] + taps[b]) - total
            out[:, d, j, 0] = values.max(axis=0)
            out[:, d, j, 1] = (values > 0).mean(axis=0)
    return out.ravel()


def layer_moments(likelihoods: DataFrame, layers: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation of ln p of every layer, over all tokens."""
    row = likelihoods.agg(
        *[F.avg(F.ln(c)).alias(f"m_{c}") for c in layers], *[F.stddev_pop(F.ln(c)).alias(f"s_{c}") for c in layers]
    ).first()
    return [row[f"m_{c}"] or 0.0 for c in layers], [row[f"s_{c}"] or 1.0 for c in layers]


def with_pooled_kernels(
    df: DataFrame, matrix: str, means: Sequence[float], deviations: Sequence[float], out: str = "kernels", dilations: Sequence[int] = DILATIONS
) -> DataFrame:
    """Replace the column ``matrix`` (positions by layers, probabilities) by the pooled kernels of its standardised logarithms.

    Missing values count as the mean of their layer, a null matrix as one without positions.
    """
    kept = [c for c in df.columns if c != matrix]
    layers, width = len(means), len(kept)
    names = [*kept, out]
    middle, scale = np.array(means), np.array([s if s > 0 else 1.0 for s in deviations])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(width):
                flat = value.values
                values = np.zeros((0, layers)) if flat is None else flat.to_numpy(zero_copy_only=False).reshape(-1, layers)
                logs = (np.log(values) - middle) / scale
                rows.append(pooled(np.where(np.isnan(logs), 0.0, logs), dilations))
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            step = feature_count(layers, dilations)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * step, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], listed], names=names)

    schema = StructType([*[df.schema[c] for c in kept], StructField(out, ArrayType(DoubleType()))])
    flattened: Column = F.transform(F.flatten(F.col(matrix)), lambda x: x.cast("double"))
    return df.select(*kept, flattened.alias("__flat")).mapInArrow(run, schema)
