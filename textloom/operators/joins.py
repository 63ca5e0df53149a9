"""Joins on ids, texts, positions and character ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.ranking import collect_parts, salted_lookup, with_rank
from textloom.session import materialize


def lookup_rewrites(df: DataFrame, part_rows: int = 1_000) -> DataFrame:
    """Per source text the ordered list of its full-text rewrites; sources
    without one are dropped.  Long lists continue in further parts."""
    sources = df.where("agent = 'human' AND first").select(
        "id_source", F.col("text").alias("source_text")
    )
    rewrites = collect_parts(
        df.where("agent <> 'human'"),
        ["id_source"],
        ["turn"],
        {"rewrites": F.struct("id_sample", "agent", "text")},
        part_rows=part_rows,
    )
    return sources.join(rewrites, "id_source")


def merge_by_text(items: DataFrame, results: DataFrame, agent: str) -> tuple[DataFrame, DataFrame]:
    """Append an agent's results to the items with the same text.

    ``items`` has (doc_id, text, agents); ``results`` has (text, result).
    Items that already list the agent stay as they are.  Returns the items and
    the results whose text no item has.  Texts are matched by sha256, and a
    text that very many items share is spread over several tasks.
    """
    keyed = items.withColumn("text_sha", F.sha2("text", 256))
    per_text = results.groupBy(F.sha2("text", 256).alias("text_sha")).agg(
        F.min("result").alias("result")
    )
    copies = keyed.groupBy("text_sha").agg(F.count("*").alias("copies"))
    found = materialize(per_text.join(copies, "text_sha", "left"), "results")
    known = found.where("copies IS NOT NULL")
    joined = salted_lookup(
        keyed, known, ["text_sha"], "copies", ["doc_id"], how="left", sizes=known
    )
    fits = F.col("result").isNotNull() & ~F.array_contains("agents", agent)
    merged = joined.select(
        *[c for c in items.columns if c != "agents"],
        F.when(fits, F.array_append("agents", F.lit(agent))).otherwise(F.col("agents")).alias("agents"),
        F.when(fits, F.col("result")).alias("result"),
    )
    return merged, found.where("copies IS NULL").drop("copies")


def zip_join(left: DataFrame, right: DataFrame, left_order: Sequence, right_order: Sequence) -> DataFrame:
    """Join by position in the stated orders; the shorter side ends the result."""
    a = with_rank(left, left_order, out="position")
    b = with_rank(right, right_order, out="position")
    return a.join(b, "position")


def pending_agent_work(items: DataFrame, done: DataFrame, agents: Sequence[str]) -> DataFrame:
    """(id, agent) pairs of the fixed agent list that have no result yet."""
    todo = items.select("id_source", F.explode(F.array(*map(F.lit, agents))).alias("agent"))
    return todo.join(done.select("id_source", "agent").distinct(), ["id_source", "agent"], "left_anti")


def map_display_names(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    """Add display name and order of a fixed list by a broadcast join (the list
    is part of the program, so its size is known)."""
    rows = [(key, name, i) for i, (key, name) in enumerate(names.items())]
    lookup = df.sparkSession.createDataFrame(rows, f"`{column}` string, name string, position int")
    return df.join(F.broadcast(lookup), column, "left")


def self_similarity(df: DataFrame, key: str, matrix: str) -> DataFrame:
    """Cosine similarity of every pair of token vectors inside one window.

    The window is one row's own fixed-length matrix, so the pairs are bounded
    by the window length, whatever the table size.  Unit diagonal.
    """
    norm = F.transform(
        matrix,
        lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x)),
    )
    unit = F.zip_with(
        matrix,
        norm,
        lambda v, n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)),
    )
    units = df.select(key, unit.alias("u"))
    left = units.select(key, "u", F.posexplode("u").alias("i", "a"))
    pairs = left.select(key, "i", "a", F.posexplode("u").alias("j", "b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.select(
        key, "i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(dot).alias("similarity")
    )


def range_relation(start: Column, end: Column, range_start: Column, range_end: Column) -> Column:
    """inside, overlapping or outside, for half-open character ranges."""
    inside = (start >= range_start) & (end <= range_end)
    touches = (start < range_end) & (end > range_start)
    return F.when(inside, "inside").when(touches, "overlapping").otherwise("outside")


def span_range_overlap(docs: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, pos, start, end, range_start, range_end, relation): every token of
    a document against the document's ranges.  The join is on documents; their
    ``offsets`` arrays are expanded after it, so single tokens are not shuffled."""
    joined = docs.select(key, "offsets").join(ranges, key)
    tokens = joined.select(
        key, "range_start", "range_end", F.posexplode("offsets").alias("pos", "t")
    ).select(key, "range_start", "range_end", "pos", "t.start", "t.end")
    return tokens.withColumn(
        "relation",
        range_relation(F.col("start"), F.col("end"), F.col("range_start"), F.col("range_end")),
    )
