"""Keyed Parquet store: absent-only inserts, appends, updates, resuming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def new_rows(existing: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key of the batch whose key the store does not hold."""
    rest = [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    ).select(key, "r.*")
    return first.join(existing.select(key), key, "left_anti")


def insert_if_absent(path: str, batch: DataFrame, key: str, order: Sequence[str]) -> None:
    """Append only unseen keys; stored rows stay untouched."""
    existing = batch.sparkSession.read.parquet(path)
    new_rows(existing, batch, key, order).select(*existing.columns).write.mode("append").parquet(path)


def append_many(path: str, batch: DataFrame) -> None:
    batch.write.mode("append").parquet(path)


def update_by_key(existing: DataFrame, updates: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Replace the given columns where the key matches (also by NULL); updates
    without a match do nothing.  Of several updates of one key the last by
    ``order`` (then by value) counts."""
    given = [c for c in updates.columns if c != key and c not in order]
    new = F.struct(*given)
    change = updates.groupBy(key).agg(F.max_by(new, F.struct(*order, *given)).alias("__new"))
    joined = existing.join(change, key, "left")
    matched = F.col("__new").isNotNull()
    return joined.select(
        *[
            F.when(matched, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
            for c in existing.columns
        ]
    )


def resume_unprocessed(df: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows whose key has no result yet; ``force`` takes all again."""
    return df if force else df.join(done.select(key).distinct(), key, "left_anti")


def metadata_key_values(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field name, value) rows of every item."""
    text = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields])
    return text.unpivot([key], list(fields), "key", "value")
