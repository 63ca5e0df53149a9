"""Rows without a key are kept by sinks, splits, weights and updates."""

from pyspark.sql import functions as F
from textloom.operators.models import class_weights
from textloom.operators.splits import stratified_split
from textloom.sources.store import update_by_key
from textloom.sources.writers import export_jsonl_bz2, publish


def test_sinks_keep_null_folders(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), (None, "x", 2), ("b", None, 3)], "config string, agent string, id_sample int")
    export_jsonl_bz2(df, str(tmp_path / "e"), "config", ["id_sample"])
    assert spark.read.json(str(tmp_path / "e")).count() == 3
    publish(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_split_and_weights_keep_null_labels(spark):
    df = spark.range(40).withColumn("label", F.when(F.col("id") % 4 > 0, (F.col("id") % 2).cast("int")))
    parts = {(r.label, r.split): r["count"] for r in stratified_split(df, "id", "label").groupBy("label", "split").count().collect()}
    assert sum(parts.values()) == 40 and parts[(None, "test")] == 2 and parts[(None, "eval")] == 1
    weights = class_weights(df).collect()
    assert len(weights) == 40 and {r.weight for r in weights if r.label is None} == {0.1}


def test_updates_of_one_key_count_once(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "c", 2)], "k int, v string, t int")
    assert sorted(map(tuple, update_by_key(store, new, "k", ["t"]).collect())) == [(1, "c"), (2, "b")]
