"""Weighted draws with replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.ranking import running_totals, seeded_uniform
from textloom.session import shuffle_partitions


#: Rows per cell of the range search, and cells written out at a time.
ROWS_PER_CELL = 8
BLOCK = 10_000


def weighted_sample(df: DataFrame, weight: Column, key: str, draws: int, seed: int) -> DataFrame:
    """``draws`` rows with replacement, each row with chance weight / total.

    Row ``i`` owns the interval [before, before + weight) of the total.  Both
    the intervals and the draws are cut into equal cells, so the range search
    is an equi-join on the cell: an interval is repeated once per cell it
    touches, which adds at most one row per cell overall.  A very heavy row is
    first cut into blocks that are spread over the tasks; its draws are spread
    with them.
    """
    weighted = df.withColumn("__w", weight).where("__w > 0")
    total, rows, heaviest = weighted.agg(F.sum("__w"), F.count("*"), F.max("__w")).first()
    if not rows:
        raise ValueError("no row has a positive weight")
    cells = max(1, rows // ROWS_PER_CELL)
    placed = running_totals(weighted, [key], {"__before": F.col("__w")})

    def cell(value: Column) -> Column:
        return F.floor(value / float(total) * cells).cast("bigint")

    owned = placed.withColumn("__after", F.col("__before") + F.col("__w")).withColumns(
        {"__first": cell(F.col("__before")), "__last": cell(F.col("__before") + F.col("__w"))}
    )
    blocks = owned.withColumn(
        "__block",
        F.explode(F.sequence(F.floor(F.col("__first") / BLOCK), F.floor(F.col("__last") / BLOCK))),
    )
    if heaviest / total * cells > BLOCK:
        blocks = blocks.repartition(shuffle_partitions(df.sparkSession), key, "__block")
    start = F.greatest(F.col("__first"), F.col("__block") * BLOCK)
    end = F.least(F.col("__last"), (F.col("__block") + 1) * BLOCK - 1)
    spread = blocks.withColumn("__cell", F.explode(F.sequence(start, end)))
    drawn = (
        df.sparkSession.range(draws)
        .select(F.col("id").alias("draw"), (seeded_uniform(seed, "id") * float(total)).alias("__u"))
        .withColumn("__cell", cell(F.col("__u")))
    )
    hit = (F.col("__u") >= F.col("__before")) & (F.col("__u") < F.col("__after"))
    return drawn.join(spread, "__cell").where(hit).select("draw", *df.columns)
