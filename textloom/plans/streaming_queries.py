"""Streams over the given tables, run until everything is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.statistics import METRICS, with_text_metrics
from textloom.operators import models as md
from textloom.plans.model_queries import features
from textloom.plans.registry import query, r6
from textloom.plans.text_queries import _per_document, _rounded
from textloom.session import SPREAD_BYTES, plan_bytes, scratch_path, table
from textloom.streaming import jobs, keyed_state


@query(
    "SM-01",
    sql="""SELECT doc_id, lang <> 'es' AS scored, CASE WHEN lang = 'es' THEN 'text is missing' END AS error,
             true AS as_batch FROM documents""",
)
def stream_score(spark, sf):
    """Spanish requests arrive without text and must not disturb the others;
    the stream's scores are those of a batch run."""
    model = md.logistic(METRICS, maxIter=20).fit(features(spark, sf))
    docs = table(spark, sf, "documents")
    text = F.when(F.col("lang") != "es", F.col("text")).alias("text")
    # The table is one file or a folder of files; a pattern names either, and the folder's files are the stream.
    requests = jobs.read_files(spark, f"{sf}/documents.parque[t]", docs.schema).select("doc_id", text)
    out = scratch_path(spark, "scores")
    jobs.stream_score(requests, model, out, scratch_path(spark, "offsets"))
    batch = jobs.score_requests(docs.select("doc_id", text), model)
    both = spark.read.parquet(out).join(batch.select("doc_id", F.col("y_score").alias("expected")), "doc_id")
    return both.select(
        "doc_id",
        F.col("y_score").isNotNull().alias("scored"),
        "error",
        F.col("y_score").eqNullSafe(F.col("expected")).alias("as_batch"),
    )


@query("SM-02", sql="SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def stream_insert_if_absent(spark, sf):
    """Every event arrives twice, an hour apart; each is stored once."""
    events = table(spark, sf, "events")
    inbox, store = scratch_path(spark, "inbox"), scratch_path(spark, "events")
    events.limit(0).write.parquet(store)
    late = events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    for part in (events, late):
        part.write.mode("append").parquet(inbox)
    rows = jobs.read_files(spark, inbox, events.schema, files_per_trigger=1)
    jobs.stream_insert_if_absent(rows, store, "event_id", "ts", scratch_path(spark, "offsets"))
    return spark.read.parquet(store).select("event_id", "user_id", "event_type", r6("value").alias("value"))


@query("SM-03", sql=_per_document(False))
def stream_features(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "stats")
    # A micro-batch takes a quarter of the files, and these are enough for every core, or of a bounded size.
    files = 4 * max(2, spark.sparkContext.defaultParallelism, -(-plan_bytes(docs) // (4 * SPREAD_BYTES)))
    docs.repartition(files, "doc_id").write.parquet(inbox)
    rows = jobs.read_files(spark, inbox, docs.schema, files_per_trigger=files // 4)
    offsets = scratch_path(spark, "offsets")
    jobs.stream_features(rows, lambda batch: with_text_metrics(batch).drop("text"), out, offsets)
    return _rounded(spark.read.parquet(out))


@query("SM-02", sql="SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def stream_first_by_key(spark, sf):
    """Every event arrives three times, up to a day apart; the state alone tells which are new."""
    events = table(spark, sf, "events")
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "events")
    for hours in (0, 2, 24):
        events.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {hours} HOUR")).write.mode("append").parquet(inbox)
    # A micro-batch costs every state partition a commit, so the files of one arrival (16 at most) make one.
    files = max(1, min(len(events.inputFiles()), 16))
    rows = jobs.read_files(spark, inbox, events.schema, files_per_trigger=files)
    keyed_state.insert_first_by_key(rows, out, "event_id", "ts", scratch_path(spark, "offsets"))
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", r6("value").alias("value"))
