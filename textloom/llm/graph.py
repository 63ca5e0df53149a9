"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.session import materialize


def _to_smallest(links: DataFrame, among: DataFrame) -> DataFrame:
    """Link every v that x sees in ``links`` (x, v), and x, to the smallest id x sees in ``among``."""
    least = among.groupBy("x").agg(F.min("v").alias("__m")).select("x", F.least("x", "__m").alias("__m"))
    hung = links.join(least, "x")
    return hung.select(F.col("v").alias("x"), F.col("__m").alias("v")).unionByName(
        hung.select("x", F.col("__m").alias("v"))
    )


def components(links: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every id in ``links`` (a, b).

    Links point from the larger id x to the smaller v.  Each round hangs every
    id and what it is linked to below it on the smallest of them, then every id
    and what is linked to it from above on the smallest id around.  Both keep
    what is connected, and the links shrink to one per id, to its component.
    Minima are combined before the shuffle, so an id with very many links is one
    row per task; the joins may be split by size.  Every round is written to the
    shared folder, and only a count and a checksum reach the driver.  Links to
    itself and repeated links do no harm; without links there are no rows.
    """

    def tidy(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.where("x > v").distinct(), "links")

    now = tidy(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("v")))
    seen = None
    while True:
        below = tidy(_to_smallest(now, now))
        around = below.unionByName(below.select(F.col("v").alias("x"), F.col("x").alias("v")))
        now = tidy(_to_smallest(around.where("v > x"), around).unionByName(below))
        # Links that are no longer needed go: only the smallest of an id is kept once its others are linked to it.
        now = tidy(_to_smallest(now, now))
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("x", "v") % 1_000_003)).first()
        if sums == seen:
            return now.select(F.col("x").alias("id"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = sums
