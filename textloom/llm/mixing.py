"""Mixing sources to target weights by exponential keys.

Every source gets a share of all words by its weight, at most ``max_epochs``
times its own size; what is above goes to the others by weight, again and
again until nothing is above.  Whole epochs of a source are taken first.  The
rest is drawn without replacement: each document has the key -ln(u) / weight
(weight: its quality), the smallest keys come first, and their sizes are summed
up to the rest of the budget.

No source is sorted in one task.  Keys are counted in cells; the cell that
holds the end of the budget is found by running totals over at most
``CELLS`` cells of a source, cut into cells once more, and only the documents
of that small cell are put in order.  Equal rows have equal keys; they are counted,
and as many of them are drawn as fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm.common import WORD
from textloom.operators.ranking import with_rank
from textloom.session import materialize

CELLS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def symbol_quality(text: Column, size: Column) -> Column:
    """Between 0.25 and 1: less, the more characters of #*$%&|<> there are per word."""
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    share = F.coalesce(marks, F.lit(0)).cast("double") / F.greatest(size, F.lit(1)).cast("double")
    return F.greatest(F.lit(0.25), F.lit(1.0) - share)


def sampling_position(seed: int, key: Column, text: Column, quality: Column) -> Column:
    """The exponential key e = -ln(u) / quality as e / (1 + e), in (0, 1); u comes from a hash of key and text.

    With the text, so that documents without a key, or that share one, are drawn independently.
    """
    name = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.md5(text.cast("binary")))
    digits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10)
    u = (digits.cast("double") + 0.5) / float(16**12)
    e = -F.log(u) / quality
    return e / (e + 1.0)


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Source, source_size, weight and target of every source.

    ``sizes`` has __source and source_size, one row each, and is read several
    times.  Sources by code point, null last, have the weights in turn.  Every
    round is one aggregate of the source table; only its totals reach the driver.
    """
    ranked = with_rank(sizes, [F.col("__source").asc_nulls_last()], out="__rank")
    turn = F.array(*[F.lit(w) for w in weights])
    weighted = materialize(
        ranked.select("__source", "source_size", F.get(turn, F.col("__rank") % len(weights)).alias("__weight")), "weights"
    )
    most = F.lit(max_epochs) * F.col("source_size")
    level, total, stopped = None, None, -1
    while True:
        above = F.lit(False) if level is None else most <= F.col("__weight") * level
        row = weighted.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, most).otherwise(0)).alias("fixed"),
            F.sum(F.when(above, 0).otherwise(F.col("__weight"))).alias("open"),
            F.sum(above.cast("int")).alias("stopped"),
        ).first()
        if not row.total or not row.open or row.stopped == stopped:
            break
        rest, share, stopped = row.total - row.fixed, row.open, row.stopped
        level, total = F.lit(float(rest)) / F.lit(float(share)), row.total
    if not total:
        return weighted.withColumn("target", F.lit(0.0))
    even = F.col("__weight").cast("double") * F.lit(float(rest)) / F.lit(float(share))
    return weighted.withColumn("target", F.when(above, most.cast("double")).otherwise(even))


def _boundary(rows: DataFrame, plan: DataFrame, cell: Column) -> DataFrame:
    """Per source the cell in which its budget ends, and the total before it."""
    by_cell = rows.groupBy("__source", cell.alias("__at")).agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("__source").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    totals = by_cell.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    joined = totals.join(
        plan.select(F.col("__source").alias("__s"), "__rest", "__first"), F.col("__source").eqNullSafe(F.col("__s"))
    )
    start = F.col("__first") + F.col("__start")
    return joined.where((start <= F.col("__rest")) & (F.col("__rest") < start + F.col("__sum"))).select(
        "__source", "__at", start.alias("__first"), "__rest"
    )


def plan_mix(rows: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Per source: sizes, target, whole epochs and where the drawn rest ends.

    ``rows`` has __source, __id, size, __x and __row and is read several times.
    """
    sizes = materialize(rows.groupBy("__source").agg(F.sum("size").alias("source_size")), "sources")
    targets = source_targets(sizes, weights, max_epochs)
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("bigint")
    targets = targets.withColumn("__epochs", epochs).withColumn("__rest", F.col("target") - F.col("__epochs") * size)
    open_ = targets.where(F.col("__rest") > 0).withColumn("__first", F.lit(0).cast("bigint"))

    coarse = F.floor(F.col("__x") * CELLS)
    fine = F.floor(F.col("__x") * (CELLS * CELLS))
    some = rows.where("size > 0")
    end = materialize(_boundary(some, open_, coarse), "boundary").withColumnRenamed("__at", "__cell")
    inside = some.join(
        end.select(F.col("__source").alias("__s"), "__cell"),
        F.col("__source").eqNullSafe(F.col("__s")) & (coarse == F.col("__cell")),
        "left_semi",
    )
    end = materialize(_boundary(inside, end, fine), "boundary").withColumnRenamed("__at", "__cell")
    last = some.join(
        end.select(F.col("__source").alias("__s"), "__cell", "__first", "__rest"),
        F.col("__source").eqNullSafe(F.col("__s")) & (fine == F.col("__cell")),
    )
    # Equal rows are one row with a count, combined before the shuffle.
    last = last.groupBy("__source", "__cell", "__first", "__rest", "__x", "__id", "size").agg(F.count("*").alias("__n"))
    before = (
        Window.partitionBy("__source").orderBy("__x", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("__first") + F.coalesce(F.sum(F.col("size") * F.col("__n")).over(before), F.lit(0))
    # A document counts if its middle lies within the budget: at most half a document off.
    fit = F.floor((2 * (F.col("__rest") - start) - F.col("size")) / (2 * F.col("size"))) + 1
    drawn = last.withColumn("__copies", F.greatest(F.lit(0).cast("bigint"), F.least(F.col("__n"), fit)))
    best = F.max(F.when(F.col("__copies") > 0, F.struct("__x", "__id", "size", "__copies", "__n")))
    cut = drawn.groupBy(F.col("__source").alias("__s")).agg(F.max("__cell").alias("__cell"), best.alias("__last"))
    cut = materialize(
        targets.join(cut, F.col("__source").eqNullSafe(F.col("__s")), "left").select(
            "__source",
            F.col("source_size").alias("__source_size"),
            F.col("target").alias("__target"),
            "__epochs",
            "__cell",
            F.when(F.col("__last").isNotNull(), F.struct("__last.__x", "__last.__id", "__last.size")).alias("__cut"),
            F.when(F.col("__last.__copies") < F.col("__last.__n"), F.col("__last.__copies")).alias("__copies"),
        ),
        "cut",
    )
    upto = last_copies(rows, cut).select(F.col("__source").alias("__s"), "__upto")
    return materialize(cut.join(upto, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s", "__copies"), "mix")


def last_copies(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """__source and __upto: the __row of the last copy drawn, for sources of which not all copies at the cut are drawn.

    Copies are counted per task that read them; only those of the task in which the last one lies are put in order.
    """
    some = cut.where(F.col("__copies").isNotNull()).select(F.col("__source").alias("__s"), "__cut", "__copies")
    tied = rows.join(
        some,
        F.col("__source").eqNullSafe(F.col("__s")) & F.struct("__x", "__id", "size").eqNullSafe(F.col("__cut")),
    ).select("__source", "__copies", "__row", F.shiftright("__row", 33).alias("__task"))
    counts = tied.groupBy("__source", "__copies", "__task").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = (F.col("__start") < F.col("__copies")) & (F.col("__copies") <= F.col("__start") + F.col("__n"))
    starts = starts.where(inside).select(F.col("__source").alias("__s"), F.col("__task").alias("__t"), "__start")
    order = Window.partitionBy("__source").orderBy("__row")
    found = tied.join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__task") == F.col("__t")))
    found = found.withColumn("__number", F.col("__start") + F.row_number().over(order))
    return found.where("__number = __copies").select("__source", F.col("__row").alias("__upto"))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 7,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The kept columns with __size, __source_size, __target and __taken.

    __taken is the number of words that the mix takes from a document, repeats
    counted: a multiple of its size, at most ``max_epochs`` times.  A document
    without words (null or empty text) takes 0.  Documents without a source form
    a source of their own, the last.  Reruns agree; rows equal in source, id and
    text are interchangeable: as many of them are drawn as the budget allows.  They
    are told apart by their place in the input, so ``docs`` should be a table, not
    the result of a shuffle.  An empty table gives no rows.  Input columns may have
    any name that does not start with two underscores.
    """
    body = F.col(f"`{text}`")
    with_size = docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__words", word_count(body))
    position = sampling_position(seed, F.col(f"`{key}`"), body, symbol_quality(body, F.col("__words")))
    names = list(keep if keep is not None else docs.columns)
    keyed = with_size.withColumn("__x", position)
    narrow = keyed.select(
        F.col(f"`{source}`").alias("__source"), F.col(f"`{key}`").alias("__id"), F.col("__words").alias("size"), "__x", "__row"
    )
    plan = plan_mix(materialize(narrow, "keys"), weights, max_epochs)

    fine = F.floor(F.col("__x") * (CELLS * CELLS))
    order = F.struct(F.col("__x"), F.col(f"`{key}`").alias("__id"), F.col("__words").alias("size"))
    upto = F.coalesce(F.col("__row") <= F.col("__upto"), F.lit(True))
    at_cut = (fine == F.col("__cell")) & ((order < F.col("__cut")) | ((order <= F.col("__cut")) & upto))
    drawn = (fine < F.col("__cell")) | at_cut
    copies = F.col("__epochs") + F.coalesce(drawn, F.lit(False)).cast("bigint")
    joined = keyed.join(plan, F.col(f"`{source}`").eqNullSafe(F.col("__source")), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("__words").alias("__size"),
        "__source_size",
        "__target",
        (F.col("__words") * copies).alias("__taken"),
    )
