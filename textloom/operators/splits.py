"""Leakage-free splits by cut-off values instead of a global sort.

A seeded shuffle is the order of a seeded hash.  To cut it at exact positions
only the hash values at those positions are needed: a histogram over hash
prefixes finds the cell of each position, and only that cell is sorted.  The
rows themselves are then labelled in one pass against a handful of cut-offs,
without being moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators.ranking import salted_lookup, seeded_hash
from textloom.session import broadcast_checked, materialize

#: Hex digits of the histogram cell: a cell holds 1 / 65536 of a stratum.
PREFIX = 4

Positions = Mapping[str, Callable[[Column], Column]]


def rank_cutoffs(hashed: DataFrame, positions: Positions, strata: Sequence[str] = ()) -> DataFrame:
    """One row per stratum: for each named position ``k(n)`` the hash ``h`` of
    the row with exactly ``k`` rows before it (NULL when ``k`` >= n).

    ``hashed`` holds the strata and the unique hash column ``h``.
    """
    strata = list(strata)
    cells = (
        hashed.groupBy(*strata, F.substring("h", 1, PREFIX).alias("cell"))
        .agg(F.count("*").alias("n"))
    )
    in_order = Window.partitionBy(*strata).orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = cells.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0))).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*strata))
    )
    wanted = placed.select(
        *strata,
        "cell",
        "before",
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("name"), k(F.col("total")).cast("bigint").alias("k"))
                    for name, k in positions.items()
                ]
            )
        ),
    )
    targets = wanted.where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("n")))
    targets = targets.select(*strata, "cell", "name", (F.col("k") - F.col("before")).alias("nth"))
    members = hashed.withColumn("cell", F.substring("h", 1, PREFIX)).join(
        broadcast_checked(targets), [*strata, "cell"]
    )
    in_cell = Window.partitionBy(*strata, "name", "cell").orderBy("h")
    hits = members.withColumn("pos", F.row_number().over(in_cell) - 1).where("pos = nth")
    picked = [F.max(F.when(F.col("name") == n, F.col("h"))).alias(n) for n in positions]
    if not strata:
        return hits.agg(*picked)
    known = cells.select(*strata).distinct()
    return known.join(hits.groupBy(*strata).agg(*picked), strata, "left")


def _label(df: DataFrame, cutoffs: DataFrame, strata: Sequence[str]) -> DataFrame:
    if strata:
        return df.join(materialize(cutoffs, "cutoffs"), list(strata))
    return df.crossJoin(F.broadcast(cutoffs))  # exactly one row


def _before(h: Column, cut: Column) -> Column:
    return cut.isNull() | (h < cut)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    test: float = 0.2,
    eval_of_rest: float = 0.125,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: per label 20 % test, then 12.5 % of the rest eval."""

    def n_test(n: Column) -> Column:
        return round_half_up(n * F.lit(test))

    # As text, so that rows without a label are a stratum like any other.
    stratum = F.to_json(F.struct(F.col(label).alias("label")))
    hashed = df.select(stratum.alias("__stratum"), seeded_hash(seed, key).alias("h"))
    cutoffs = rank_cutoffs(
        hashed,
        {
            "__test": n_test,
            "__eval": lambda n: n_test(n) + round_half_up((n - n_test(n)) * F.lit(eval_of_rest)),
        },
        strata=["__stratum"],
    )
    h = seeded_hash(seed, key)
    split = (
        F.when(_before(h, F.col("__test")), "test")
        .when(_before(h, F.col("__eval")), "eval")
        .otherwise("train")
    )
    labelled = _label(df.withColumn("__stratum", stratum), cutoffs, ["__stratum"])
    return labelled.select(*df.columns, split.alias("split"))


def matched_ids(df: DataFrame, agents: Iterable[str] | None = None) -> DataFrame:
    """(id_source, n): ids with a human row and a row of the agents (any
    non-human agent when none are named); ``n`` counts all rows of the id."""
    other = F.col("agent") != "human"
    if agents is not None:
        other = F.col("agent").isin(list(agents))
    flags = df.groupBy("id_source").agg(
        F.bool_or(F.col("agent") == "human").alias("human"),
        F.bool_or(other).alias("other"),
        F.count("*").alias("n"),
    )
    return flags.where("human AND other").select("id_source", "n")


def _of_agents(df: DataFrame, agents: Iterable[str] | None) -> DataFrame:
    return df if agents is None else df.where(F.col("agent").isin([*agents, "human"]))


def matched_unmatched(df: DataFrame, agents: Iterable[str] | None = None):
    """(rows of matched ids and the wanted agents, all rows of other ids)."""
    ids = materialize(matched_ids(df, agents), "matched")
    on = (ids, ["id_source"], "n", ["id_sample"])
    matched = salted_lookup(_of_agents(df, agents), *on, how="left_semi", sizes=ids)
    unmatched = salted_lookup(df, *on, how="left_anti", sizes=ids)
    return matched, unmatched


def matched_split(
    df: DataFrame,
    agents: Iterable[str] | None = None,
    eval_split: float = 0.1,
    test_split: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` (train, eval, test, unmatched); rows follow their id."""
    ids = materialize(matched_ids(df, agents), "matched")
    h = seeded_hash(seed, "id_source")
    cutoffs = rank_cutoffs(
        ids.select(h.alias("h")),
        {
            "__eval": lambda n: F.floor(n * F.lit(1 - eval_split - test_split)),
            "__test": lambda n: F.floor(n * F.lit(1 - test_split)),
        },
    )
    split = (
        F.when(_before(h, F.col("__eval")), "train")
        .when(_before(h, F.col("__test")), "eval")
        .otherwise("test")
    )
    placed = _label(ids, cutoffs, []).select("id_source", "n", split.alias("split"))
    joined = salted_lookup(
        df, placed, ["id_source"], "n", ["id_sample"], "left", sizes=ids
    ).drop("n")
    split = F.coalesce("split", F.lit("unmatched"))
    out = joined.select(*df.columns, split.alias("split"))
    if agents is None:
        return out
    # Unmatched ids keep all their rows; matched ones only the wanted agents.
    return out.where((F.col("split") == "unmatched") | F.col("agent").isin([*agents, "human"]))


def part_start(n: Column, part: int, parts: int) -> Column:
    """First position of a part when n rows form nearly equal parts (the first
    ``n % parts`` get one more)."""
    return F.lit(part) * F.floor(n / parts) + F.least(F.lit(part), n % parts)


def with_part(df: DataFrame, key: str, parts: int, seed: int = 42, out: str = "part") -> DataFrame:
    """Add the 0-based part of each row's key in the seeded order; keys are unique."""
    h = seeded_hash(seed, key)
    cuts = {f"__cut{i}": (lambda n, i=i: part_start(n, i, parts)) for i in range(1, parts)}
    cutoffs = rank_cutoffs(df.select(h.alias("h")), cuts)
    reached = [F.when(F.col(c).isNull() | (h < F.col(c)), 0).otherwise(1) for c in cuts]
    part = sum(reached[1:], reached[0]) if reached else F.lit(0)
    return _label(df, cutoffs, []).select(*df.columns, part.cast("int").alias(out))


def fold_split(part: Column, fold: Column, parts: int, evals: int = 1, tests: int = 2) -> Column:
    """Split of a part in a fold: ``evals`` parts from the fold on are eval,
    the next ``tests`` are test, the others train."""
    if not (evals > 0 and tests > 0 and evals + tests < parts):
        raise ValueError("evals and tests must be positive and leave parts for training")
    turn = F.pmod(part - fold, F.lit(parts))
    return F.when(turn < evals, "eval").when(turn < evals + tests, "test").otherwise("train")


def cv_rotation(
    df: DataFrame,
    agents: Iterable[str] | None = None,
    parts: int = 10,
    evals: int = 1,
    tests: int = 2,
    seed: int = 42,
) -> DataFrame:
    """(id_source, fold, split) for every matched id and fold."""
    ids = materialize(matched_ids(df, agents), "matched")
    placed = with_part(ids, "id_source", parts, seed)
    folds = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    split = fold_split(F.col("part"), F.col("fold"), parts, evals, tests)
    return folds.select("id_source", "fold", split.alias("split"))


def take_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """The first ``int(n * fraction)`` unique keys in the seeded order."""
    h = seeded_hash(seed, key)
    cutoffs = rank_cutoffs(
        df.select(h.alias("h")), {"__cut": lambda n: F.floor(n * F.lit(fraction))}
    )
    return _label(df, cutoffs, []).where(_before(h, F.col("__cut"))).select(*df.columns)
