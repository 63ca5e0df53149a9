"""Name -> (Spark query, SQL check) and the inventory ids each one covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.session import spread, spread_small, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERAGE: dict[str, tuple[str, ...]] = {}


def query(*covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        QUERIES[fn.__name__] = fn
        COVERAGE[fn.__name__] = covers
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def r6(col: Column | str) -> Column:
    """Six decimals, without negative zero, for comparison across engines."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), 6) + F.lit(0.0)



# --- shared inputs -----------------------------------------------------------

def corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents, spread over the cores when the file alone is too small for that."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *columns)
    return spread_small(docs, "doc_id")


def spread_corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents, dealt by id whatever the size: for what is grouped or joined by document and far
    larger than its text."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns), "doc_id")


HUMAN, SYSTEM = "human", "system"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired samples: a conversation is a source text, each turn one sample."""
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id_sample"),
        F.col("conv_id").alias("id_source"),
        "turn",
        F.when(role == "user", HUMAN).otherwise(role).alias("agent"),
        F.when(role == "user", 0).otherwise(1).alias("label"),
        "text",
    )


SAMPLES = """(SELECT conv_id || '-' || turn AS id_sample, conv_id AS id_source, turn,
  CASE WHEN role = 'user' THEN 'human' ELSE role END AS agent,
  CASE WHEN role = 'user' THEN 0 ELSE 1 END AS label, text FROM conversations)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score in [0, 1): n_chars / (n_chars + 1000)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"))
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "lang",
        "source",
        "y_true",
        (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("y_score"),
    )


SCORED = """(SELECT doc_id, lang, source, quality AS y_true,
  n_chars::DOUBLE / (n_chars + 1000.0::DOUBLE) AS y_score FROM documents JOIN labels USING (doc_id))"""
