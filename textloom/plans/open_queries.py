"""Rows from functions and open metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import variants as vr
from textloom.operators import table_functions as tf
from textloom.plans.registry import corpus, query
from textloom.session import table


@query(
    "PF-02",
    sql="""SELECT doc_id, i::BIGINT AS line_no, length(line)::BIGINT AS n_chars FROM (SELECT doc_id, unnest(l) AS line,
             generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''""",
)
def flat_map_function(spark, sf):
    """A Python function that gives a row for every line with text."""

    def lines(row):
        for i, line in enumerate((row["text"] or "").split("\n")):
            if line:
                yield {"doc_id": row["doc_id"], "line_no": i, "n_chars": len(line)}

    return tf.flat_map(corpus(spark, sf), lines, "doc_id long, line_no long, n_chars long")


@query(
    "PF-02",
    "UD-01",
    sql="""SELECT user_id, event_type, first_id, last_id, n FROM (SELECT user_id, event_type, g, min(event_id) AS first_id,
             max(event_id) AS last_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id)
               - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) GROUP BY user_id, event_type, g)""",
)
def equal_runs(spark, sf):
    """Runs of one event type of a user, by a table function over the partitioned table."""
    tf.register(spark)
    table(spark, sf, "events").select("user_id", "event_id", "event_type").createOrReplaceTempView("textloom_events")
    found = spark.sql(
        "SELECT * FROM equal_runs(TABLE(textloom_events) PARTITION BY user_id ORDER BY (event_id), 'user_id', 'event_id', 'event_type')"
    )
    return found.withColumnsRenamed({"first": "first_id", "last": "last_id"})


@query(
    "PF-02",
    sql="""SELECT doc_id, unnest(w) AS word, unnest(list_transform(w, lambda x: length(x)))::INT AS n_chars
           FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
def explode_zipped(spark, sf):
    """Two lists of a row side by side; the result's schema follows from the arguments."""
    tf.register(spark)
    words = corpus(spark, sf).select("doc_id", F.split("text", " ").alias("word"))
    words.withColumn("n_chars", F.transform("word", F.length)).createOrReplaceTempView("textloom_words")
    return spark.sql("SELECT * FROM explode_zipped(TABLE(textloom_words), 'word', 'n_chars')")


@query(
    "PF-22",
    "SC-30",
    sql="""SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type AS kind, NULL::VARCHAR AS absent,
             CASE WHEN value > 50 THEN round(value, 6) + 0.0::DOUBLE END AS high FROM events""",
)
def metadata_variant(spark, sf):
    """Events with all but their key in one open value; ``high`` is a key that only some of them have."""
    events = table(spark, sf, "events").select(
        "event_id",
        vr.open_value(F.col("props")).alias("props"),
        "event_type",
        F.when(F.col("value") > 50, F.round("value", 6)).alias("high"),
    )
    packed = vr.with_open_metadata(events, ["event_id"])
    value = F.col("metadata")
    return packed.select(
        "event_id",
        vr.read_path(value, "$.props.k", "bigint").alias("k"),
        vr.read_path(value, "$.event_type", "string").alias("kind"),
        vr.read_path(value, "$.props.no.such[3]", "string").alias("absent"),
        (vr.read_path(value, "$.high", "double") + F.lit(0.0)).alias("high"),
    )
