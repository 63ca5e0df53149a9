"""Five stages from raw documents to token counts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import language, line_dedup, mixing, near_dup, queries, sentencepiece_bpe
from textloom.session import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified go; lang becomes the identified one."""
    found = language.identify(docs, "text", queries.LANGUAGES, declared=F.col("lang"), host=F.col("source"))
    kept = found.where("__accepted").withColumn("lang", F.col("__lang"))
    return kept.select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from their first to their last line; n_chars follows the text.

    Chunks cut by a rolling hash miss the ends of a passage and most passages of
    two to five lines, so every two neighbouring lines are compared instead.
    """
    found = line_dedup.remove_passages(docs)
    length = F.when(F.col("__n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays (five words, similarity 0.8).

    Rows are compared by their texts alone: rows that share an id are not linked for
    that, and copies go also when they carry the same id.  Texts without words stay.
    """
    # Written with their numbers, so that a row keeps its number if a task runs again.
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = near_dup.near_duplicates(rows, key="__row")
    gone = found.where("NOT kept").select(F.col("__id").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs)
    taken = mixed.where(F.col("__taken") > 0)
    copies = F.explode(F.sequence(F.lit(1), (F.col("__taken") / F.col("__size")).cast("int"))).alias("__copy")
    return taken.select(*docs.columns, copies).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return sentencepiece_bpe.encode_decode(docs, queries.sentencepiece_model())


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix),
    ("tokens", tokenize),
]

#: Language scores and merges have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
