"""Sinks: numbered files, compressed exports, XML, predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.evaluation import on_groups
from textloom.session import shuffle_partitions


def write_chunked(df: DataFrame, path: str, records_per_file: int) -> None:
    """JSON files of at most ``records_per_file`` rows."""
    df.write.option("maxRecordsPerFile", records_per_file).json(path)


def by_folder(df: DataFrame, keys: Sequence[str], spread: Sequence[str], rows_per_file: int) -> DataFrame:
    """Shuffle rows so that every folder gets few, evenly sized files.

    Without it each task would write a small file into each folder; grouping
    by the keys alone would leave a hot folder to one task.  The number of
    files of a folder follows from its row count.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows_per_file).alias("__files"))
    sized = on_groups(df, sizes, keys)
    number = F.pmod(F.xxhash64(*spread), F.col("__files"))
    tasks = shuffle_partitions(df.sparkSession)
    return sized.withColumn("__file", number).repartition(tasks, *keys, "__file").drop("__files", "__file")


def export_jsonl_bz2(
    df: DataFrame, path: str, key: str, spread: Sequence[str], rows_per_file: int = 1_000_000
) -> None:
    """Compressed JSON lines, one folder per value of ``key``."""
    by_folder(df, [key], spread, rows_per_file).write.partitionBy(key).option(
        "compression", "bzip2"
    ).json(path)


def publish(
    df: DataFrame,
    path: str,
    keys: Sequence[str] = ("config", "agent"),
    spread: Sequence[str] = ("id_sample",),
    rows_per_file: int = 1_000_000,
) -> None:
    """Parquet folders per configuration and agent; only folders that get new
    rows are replaced, so publishing again is safe."""
    by_folder(df, keys, spread, rows_per_file).write.partitionBy(*keys).option(
        "partitionOverwriteMode", "dynamic"
    ).mode("overwrite").parquet(path)


def xml_safe(text: Column) -> Column:
    """Drop the characters XML 1.0 does not allow in the basic plane's ranges."""
    return F.regexp_replace(text, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}]", "")


def write_xml_documents(df: DataFrame, path: str, text: str = "text", row_tag: str = "document") -> None:
    """One XML element per row with a sanitised text."""
    clean = df.withColumn(text, xml_safe(F.col(text)))
    clean.write.format("xml").option("rootTag", "documents").option("rowTag", row_tag).save(path)


def fill_predictions(template: DataFrame, scores: DataFrame, decimals: int | None = None) -> DataFrame:
    """(id, score) in the template's ids, with optionally rounded scores."""
    score = F.col("score") if decimals is None else F.round("score", decimals)
    return template.select("id").join(scores.select("id", score.alias("score")), "id", "left")


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select("id", "score").write.option("ignoreNullFields", False).json(path)
