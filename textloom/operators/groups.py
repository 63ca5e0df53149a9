"""Grouping rows into documents and corpus-level summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.statistics import METRICS
from textloom.operators.evaluation import on_groups
from textloom.operators.ranking import collect_parts


def group_documents(
    df: DataFrame,
    by: str,
    order: Sequence[str],
    deduplicate: Sequence[str] = (),
    aggregate: Sequence[str] = (),
    remainder_into: str | None = None,
    part_rows: int = 1_000,
) -> DataFrame:
    """Group by a column: ``deduplicate`` columns keep their last value,
    ``aggregate`` columns become lists in row order, and the rest goes into a
    list of structs or is dropped.  Lists longer than ``part_rows`` continue
    in the next ``part``, so a hot key never becomes one row.
    """
    lists: dict[str, Column | str] = {c: c for c in aggregate if c not in deduplicate}
    if remainder_into:
        rest = [c for c in df.columns if c not in {by, *deduplicate, *aggregate}]
        lists[remainder_into] = F.struct(*rest)
    parts = collect_parts(df, [by], order, lists, part_rows=part_rows)
    kept = [c for c in deduplicate if c != by]
    if not kept:
        return parts
    position = F.struct(*order)
    last = df.groupBy(by).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in kept]
    )
    return on_groups(parts, last, [by])


def paired_samples(df: DataFrame, fields: Sequence[str], part_rows: int = 1_000) -> DataFrame:
    """Samples of one source text as a list; sources with a single sample go.

    Part 0 of a longer list is full and later parts only exist for long
    lists, so the size test needs no second pass.
    """
    parts = collect_parts(
        df, ["id_source"], ["turn"], {"samples": F.struct(*fields)}, part_rows=max(2, part_rows)
    )
    return parts.where((F.size("samples") >= 2) | (F.col("part") > 0))


def regroup_lines(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], line: str, part_rows: int = 1_000
) -> DataFrame:
    """Ordered lines per key and their joined text."""
    parts = collect_parts(df, keys, order, {"chunks": line}, part_rows=part_rows)
    return parts.withColumn("text", F.array_join("chunks", " "))


def label_distribution(df: DataFrame, split: str, label: str) -> DataFrame:
    counts = df.groupBy(split, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(split))
    return counts.withColumn("percent", 100 * F.col("n") / total)


def _moments() -> list[Column]:
    return [
        agg(m).alias(f"{m}_{name}")
        for m in METRICS
        for name, agg in (("mean", F.avg), ("std", F.stddev_samp))
    ]


def metrics_overall(df: DataFrame) -> DataFrame:
    """(metric, mean, std): sample standard deviation, one row per statistic."""
    wide = df.agg(*_moments())
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"{m}_mean").alias("mean"),
            F.col(f"{m}_std").alias("std"),
        )
        for m in METRICS
    ]
    return wide.select(F.inline(F.array(*rows)))


def metrics_by_group(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and deviation per group; NULL keys are a group of their own."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *_moments())


def metrics_grouping_sets(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overall, every single key and all keys together in one aggregate.

    ``level`` is the grouping bit mask: 0 is the full breakdown, all bits set
    the overall row.  The statistics are computed before the rows are
    expanded, and only the numeric columns take part.
    """
    sets = [[], *[[k] for k in keys], list(keys)]
    narrow = df.select(*keys, *METRICS)
    return narrow.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), *_moments()
    )


def cross_domain_matrix(df: DataFrame, rows: str, columns: str, values: Sequence[str], score: str):
    """Mean score by (train domain, test domain) with the row average.

    One column per given value and ``other`` for all the rest, NULL included;
    the average is that of the columns that have rows.
    """
    column = F.col(columns)
    cells = {v: column == v for v in values} | {"other": F.coalesce(~column.isin(list(values)), F.lit(True))}
    matrix = df.groupBy(rows).agg(*[F.avg(F.when(hit, F.col(score))).alias(v) for v, hit in cells.items()])
    filled = [F.coalesce(F.col(v), F.lit(0.0)) for v in cells]
    present = [F.when(F.col(v).isNull(), 0).otherwise(1) for v in cells]
    return matrix.withColumn("average", F.try_divide(sum(filled[1:], filled[0]), sum(present[1:], present[0])))


def token_budget(df: DataFrame, tokens: Column, cap: int, price_per_million: float) -> DataFrame:
    """Tokens to send (one more per sample), whole and capped, with their cost."""
    n = F.size(tokens)
    whole = F.sum((n + 1).cast("bigint"))
    capped = F.sum((F.least(n, F.lit(cap)) + 1).cast("bigint"))
    return df.agg(
        whole.alias("n_tokens"),
        (whole / 1_000_000 * price_per_million).alias("cost"),
        capped.alias("n_tokens_capped"),
        (capped / 1_000_000 * price_per_million).alias("cost_capped"),
    )


def label_sanity(df: DataFrame, split: str, spans: str, labels: str) -> DataFrame:
    """Per split and in total (NULL split): rows, rows with a label outside
    {0, 1}, rows whose numbers of labels and spans differ."""
    checked = df.select(
        split,
        F.exists(labels, lambda x: ~x.isin(0, 1)).alias("bad"),
        (F.size(labels) != F.size(spans)).alias("uneven"),
    )
    return checked.rollup(split).agg(
        F.count("*").alias("n"),
        F.count_if("bad").alias("bad_label"),
        F.count_if("uneven").alias("bad_length"),
    )


def sampling_weights(df: DataFrame, labels: str) -> DataFrame:
    """Add the inverse class frequency of each sample (positive when any span
    is) and the negative/positive span ratio; empty classes count as one."""
    positives = F.size(F.filter(labels, lambda x: x > 0.5))
    marked = df.withColumns(
        {"__pos": positives, "__neg": F.size(labels) - positives, "positive": (positives > 0).cast("int")}
    )
    one = F.lit(1)
    totals = marked.agg(
        F.greatest(F.count_if(F.col("positive") == 1), one).alias("__samples_pos"),
        F.greatest(F.count_if(F.col("positive") == 0), one).alias("__samples_neg"),
        (
            F.greatest(F.sum("__neg"), one).cast("double") / F.greatest(F.sum("__pos"), one)
        ).alias("pos_weight"),
    )
    joined = marked.crossJoin(F.broadcast(totals))  # exactly one row
    size = F.when(F.col("positive") == 1, F.col("__samples_pos")).otherwise(F.col("__samples_neg"))
    return joined.select(*df.columns, "positive", (1.0 / size).alias("weight"), "pos_weight")
