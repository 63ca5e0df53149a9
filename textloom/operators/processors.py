"""User-defined surface: batched maps, detectors, pre-/post-processor pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType


def batched_map(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType
) -> DataFrame:
    """Apply ``fn`` to Arrow batches; its result replaces the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


class Detector(Protocol):
    """Scores texts batch by batch; predictions are optional (NULL)."""

    def process(self, texts: pd.Series) -> pd.DataFrame:
        """Columns ``y_score`` and ``y_pred``."""


def run_detector(df: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """Add ``y_score`` and ``y_pred`` of a detector (only the text crosses to Python)."""

    @F.pandas_udf("y_score double, y_pred int")
    def score(texts: pd.Series) -> pd.DataFrame:
        return detector.process(texts)[["y_score", "y_pred"]]

    return (
        df.withColumn("__scored", score(F.col(text)))
        .withColumns({"y_score": F.col("__scored.y_score"), "y_pred": F.col("__scored.y_pred")})
        .drop("__scored")
    )


@dataclass
class Processor:
    """A pre-processing step and the step that undoes or completes it."""

    pre: Callable[[DataFrame], DataFrame]
    post: Callable[[DataFrame], DataFrame] = lambda df: df
    required: tuple[str, ...] = ()
    added: tuple[str, ...] = field(default_factory=tuple)

    def pre_process(self, df: DataFrame) -> DataFrame:
        absent = [c for c in self.required if c not in df.columns]
        if absent:
            raise KeyError(f"missing required columns: {absent}")
        out = df.transform(self.pre)
        missing = [c for c in self.added if c not in out.columns]
        if missing:
            raise ValueError(f"pre-processing did not add: {missing}")
        return out

    def post_process(self, df: DataFrame) -> DataFrame:
        """Complete the work, then drop the columns that only served it."""
        return df.transform(self.post).drop(*self.added)
