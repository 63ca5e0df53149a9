"""The committing sink and the keyed state."""

import json
import os
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from textloom.sources import committed
from textloom.streaming import jobs, keyed_state

SCHEMA = "id long, text string, tags array<string>"
ROWS = [(i, None if i % 7 == 0 else f"text <{i}> & é", ["a", str(i)]) for i in range(50)]


def test_rows_and_totals(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(ROWS, SCHEMA)
    committed.write_committed(df.repartition(4), path)
    committed.write_committed(df.where("id < 5").repartition(3), path)
    found = committed.read_committed(spark, path, SCHEMA)
    assert Counter(r["id"] for r in found.collect()) == Counter([i for i, *_ in ROWS] + list(range(5)))
    assert {(r["id"], r["text"], tuple(r["tags"])) for r in found.collect()} == {(i, t, tuple(g)) for i, t, g in ROWS}
    listed = sorted(committed.manifests(spark, path).collect(), key=lambda r: r["rows"])
    assert [r["rows"] for r in listed] == [5, 50] and all(r["collected_at"] is not None for r in listed)
    sizes = {f: os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-")}
    assert sum(sizes.values()) == sum(r["bytes"] for r in listed)
    assert all(p["bytes"] == sizes[p["file"]] for r in listed for p in r["parts"])


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    broken = df.withColumn("id", F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        committed.write_committed(broken, path)
    for _ in range(50):  # tasks that were running are stopped a little later
        left = [f for f in os.listdir(path) if f.startswith("part-")] if os.path.exists(path) else []
        if not left:
            break
        time.sleep(0.1)
    assert left == [] and not os.path.exists(f"{path}/{committed.MANIFESTS}")
    committed.write_committed(df, path)
    assert committed.read_committed(spark, path, SCHEMA).count() == 50


def test_a_task_that_ends_after_its_job_failed_leaves_nothing(tmp_path, monkeypatch):
    class Context:
        partitionId = taskAttemptId = lambda self: 0

    monkeypatch.setattr(committed.TaskContext, "get", lambda: Context())
    writer = committed.CommittedWriter(StructType([StructField("id", LongType())]), {"path": str(tmp_path / "out")})
    batch = pa.RecordBatch.from_pylist([{"id": 1}])

    def batches():
        writer.abort([None])
        yield batch

    assert writer.write(iter([batch])).rows == 1
    for late in (batches(), iter([batch])):  # failed while the task writes, and before it begins
        with pytest.raises(RuntimeError, match="has failed"):
            writer.write(late)
        assert not [f for f in os.listdir(tmp_path / "out") if f.startswith("part-")]


def test_parts_without_a_manifest_are_no_data(spark, tmp_path):
    path = str(tmp_path / "out")
    committed.write_committed(spark.createDataFrame(ROWS, SCHEMA), path)
    with open(f"{path}/part-other-0-0.jsonl", "w") as f:
        f.write(json.dumps({"id": 999, "text": "lost job"}) + "\n")
    assert committed.read_committed(spark, path, SCHEMA).where("id = 999").count() == 0


def test_one_xml_document_per_row(spark, tmp_path):
    path = str(tmp_path / "out")
    committed.write_committed(spark.createDataFrame(ROWS, SCHEMA).select("id", "text").repartition(3), path, "xml")
    files = [f for f in os.listdir(path) if f.endswith(".xml")]
    back = spark.read.format("xml").option("rowTag", "document").schema("id long, text string").load(f"{path}/*.xml")
    assert len(files) == 50 and {(r["id"], r["text"]) for r in back.collect()} == {(i, t) for i, t, _ in ROWS}


def test_an_empty_table_commits_an_empty_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    committed.write_committed(spark.createDataFrame([], SCHEMA), path)
    assert [r["rows"] for r in committed.manifests(spark, path).collect()] == [0]


EVENTS = "key long, at long, value string"


def arrive(spark, inbox, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(inbox)


def run(spark, tmp_path, ttl_ms=None):
    schema = spark.createDataFrame([], EVENTS).schema
    rows = jobs.read_files(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    return keyed_state.insert_first_by_key(rows, str(tmp_path / "out"), "key", "at", str(tmp_path / "offsets"), ttl_ms)


def test_late_repeats_stay_out_after_a_restart(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), [(1, 5, "b"), (1, 3, "a"), (2, 1, "x"), (1, 9, "c")])
    first = run(spark, tmp_path)
    assert first[-1]["keys"] == 2
    # Days later, in a new run with the same checkpoint.
    arrive(spark, str(tmp_path / "in"), [(1, 10**9, "late"), (3, 10**9, "new"), (None, 1, "no key")])
    second = run(spark, tmp_path)
    found = {(r["key"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(1, "a"), (2, "x"), (3, "new"), (None, "no key")}
    assert second[-1]["keys"] == 4 and second[-1]["batch"] > first[-1]["batch"]
    assert run(spark, tmp_path) == []


def test_forgotten_keys_come_again(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), [(1, 1, "a")])
    run(spark, tmp_path, ttl_ms=1)
    time.sleep(1)
    arrive(spark, str(tmp_path / "in"), [(1, 2, "b")])
    run(spark, tmp_path, ttl_ms=1)
    assert {r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b"}


def test_keys_that_share_a_bucket_are_told_apart(spark, tmp_path):
    schema = spark.createDataFrame([], EVENTS).schema
    arrive(spark, str(tmp_path / "in"), [(k, at, f"{k}-{at}") for k in (*range(300), None) for at in (7, 3, 9)])
    arrive(spark, str(tmp_path / "in"), [(k, 1, "late") for k in (*range(100), None)] + [(1000, 2, "new")])
    rows = jobs.read_files(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    fresh = keyed_state.first_by_key(rows, "key", "at", buckets=2)
    spark.conf.set(keyed_state.PROVIDER, keyed_state.ROCKSDB)
    try:
        writer = fresh.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        jobs.run_to_end(writer.option("checkpointLocation", str(tmp_path / "offsets")))
    finally:
        spark.conf.unset(keyed_state.PROVIDER)
    found = sorted(str(r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == sorted([f"{k}-3" for k in (*range(300), None)] + ["new"])


def test_stream_score_reads_a_table_of_several_files(spark, sf_dir, tmp_path):
    import __spark_entry__

    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    found = __spark_entry__.QUERIES["stream_score"](spark, str(tmp_path)).collect()
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(r["as_batch"] for r in found)
