"""Ranks and running totals that do not put a large group into one task.

A plain window sorts each partition key in one task.  That is the best plan
while the largest group is small, so its size is checked first.  Above the
limit the rows are range-partitioned by (keys, order), so a single hot key
spreads over many tasks; every task then computes its own running total, and
the per-task totals (at most one row per task and key) supply the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.session import materialize, one_use_shuffles, shuffle_partitions

#: Largest group that one task sorts on its own.
DIRECT_ROWS = 2_000_000

#: Buckets in which groups are counted before they are counted one by one.
HASH_BUCKETS = 1 << 14


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Number of rows of the largest key group (map-side combined count)."""
    if not keys:
        return df.count()
    with one_use_shuffles(df.sparkSession):
        row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return row[0] or 0


def groups_within(df: DataFrame, keys: Sequence[str], most: int) -> bool:
    """Whether no key group has more than ``most`` rows.

    Groups are first counted by the hash of their keys: no bucket is smaller than a group in it, so
    small buckets prove it and only a short list of counts is shuffled.  Else the groups are counted.
    """
    if keys:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(HASH_BUCKETS)).alias("__bucket")
        if largest_group(df.select(bucket), ["__bucket"]) <= most:
            return True
    return largest_group(df, keys) <= most


def running_totals(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
    direct_rows: int = DIRECT_ROWS,
    direct: bool | None = None,
) -> DataFrame:
    """Add, for each name in ``sums``, the total of that column over all rows
    of the same key that come strictly before the row.

    ``order`` must be unique within a key: the result is then deterministic
    and any hot key can be cut at every row.  ``direct`` says whether the groups
    are small enough for one task each, if that is known (see ``groups_within``).
    """
    keys = list(keys)
    if groups_within(df, keys, direct_rows) if direct is None else direct:
        before = (
            Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        )
        zero = {name: F.sum(col).over(before) for name, col in sums.items()}
        return df.withColumns({n: F.coalesce(c, F.lit(0)) for n, c in zero.items()})

    tasks = shuffle_partitions(df.sparkSession)
    # The partition number must not change between the two uses below, hence
    # the written table.
    laid_out = materialize(
        df.withColumns({f"__add_{n}": c for n, c in sums.items()})
        .repartitionByRange(tasks, *keys, *order)
        .withColumn("__task", F.spark_partition_id()),
        "totals",
    )
    in_task = (
        Window.partitionBy("__task", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier_tasks = (
        Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    )
    per_task = laid_out.groupBy("__task", *keys).agg(
        *[F.sum(f"__add_{n}").alias(f"__sum_{n}") for n in sums]
    )
    offsets = per_task.select(
        F.col("__task").alias("__o_task"),
        *[F.col(k).alias(f"__o_{k}") for k in keys],
        *[
            F.coalesce(F.sum(f"__sum_{n}").over(earlier_tasks), F.lit(0)).alias(f"__off_{n}")
            for n in sums
        ],
    )
    local = laid_out.withColumns(
        {f"__in_{n}": F.coalesce(F.sum(f"__add_{n}").over(in_task), F.lit(0)) for n in sums}
    )
    match = F.col("__task") == F.col("__o_task")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    joined = local.join(offsets, match, "left")
    totals = joined.select(
        *df.columns,
        *[(F.col(f"__in_{n}") + F.col(f"__off_{n}")).alias(n) for n in sums],
    )
    totals._textloom_path = laid_out._textloom_path  # for ``release`` once they are written
    return totals


def with_rank(
    df: DataFrame,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
    out: str = "rank",
    direct_rows: int = DIRECT_ROWS,
    direct: bool | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its key."""
    return running_totals(
        df, order, {out: F.lit(1).cast("bigint")}, keys=keys, direct_rows=direct_rows, direct=direct
    )


#: Up to this rank Spark cuts every group inside each map task, before the
#: shuffle (``spark.sql.optimizer.windowGroupLimitThreshold``).
GROUP_LIMIT = 1_000


def first_per_group(
    df: DataFrame, order: Sequence[Column | str], keys: Sequence[str], n: int, out: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of every group with their 0-based rank.

    For small ``n`` a filtered row number lets each map task keep only its own
    first ``n`` rows per group, so a hot group shrinks before it is shuffled.
    """
    if n > GROUP_LIMIT or not keys:
        return with_rank(df, order, keys=keys, out=out).where(F.col(out) < n)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn("__number", number).where(F.col("__number") <= n)
    return kept.withColumn(out, (F.col("__number") - 1).cast("bigint")).drop("__number")


def seeded_hash(seed: int | str, *cols: str | Column) -> Column:
    """Uniform hex string of the given columns; the seed plays the part of a
    random seed, so a shuffle is an order by this value."""
    parts = [F.lit(str(seed))] + [
        (F.col(c) if isinstance(c, str) else c).cast("string") for c in cols
    ]
    return F.md5(F.concat_ws(":", *parts))


def seeded_uniform(seed: int | str, *cols: str | Column) -> Column:
    """Number in [0, 1) from the first 12 hex digits of ``seeded_hash``."""
    return F.conv(F.substring(seeded_hash(seed, *cols), 1, 12), 16, 10).cast("double") / float(
        16**12
    )


def collect_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    lists: Mapping[str, Column | str],
    part_rows: int = 1_000,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Ordered lists per key, cut into parts of at most ``part_rows`` entries.

    A key with no more than ``part_rows`` rows gives exactly one row (part 0).
    A hot key gives several, in order, whose concatenation is the whole list,
    so nothing is dropped and no task holds an unbounded array.
    """
    ranked = with_rank(df, order, keys=keys, out="__pos", direct_rows=direct_rows)
    entry = F.struct(
        F.col("__pos"),
        *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in lists.items()],
    )
    grouped = (
        ranked.withColumn("part", F.floor(F.col("__pos") / part_rows).cast("bigint"))
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(entry)).alias("__rows"))
    )
    return grouped.select(
        *keys,
        "part",
        *[F.col("__rows").getField(n).alias(n) for n in lists],
    )


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread: Sequence[str],
    how: str = "inner",
    hot_share: float = 0.002,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` (inner, left, left_semi, left_anti) with a table that is
    unique by ``keys`` and whose ``weight`` column says how often each key
    occurs on the left.

    Keys that hold more than ``hot_share`` of the total weight are split over
    several join tasks.  There are at most ``1 / hot_share`` of them, so their
    list is broadcast safely.  ``spread`` names left columns that vary within
    a hot key.  ``sizes`` is a stored table with the same keys and weights;
    without it ``right``, which is used three times, is written first.
    """
    keys = list(keys)
    if sizes is None:
        right = sizes = materialize(right, "lookup")
    weights = sizes.select(*keys, weight)
    total = weights.agg(F.sum(weight).alias("__total"))  # exactly one row
    salts = F.ceil(F.col(weight) / (F.col("__total") * F.lit(hot_share))).cast("int")

    def salted(df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(total)).withColumn("__salts", salts).drop("__total")

    hot = salted(weights).where("__salts > 1").select(*keys, "__salts")
    sized = salted(right)
    salted_right = sized.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__salts"), F.lit(1)) - 1))
    ).drop("__salts")
    salted_left = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("__salts", F.lit(1))).cast("int"))
        .drop("__salts")
    )
    return salted_left.join(salted_right, [*keys, "__salt"], how).drop("__salt")
