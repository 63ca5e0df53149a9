"""Detector evaluation: confusion counts, AUROC, thresholds, reports.

Input rows are ``(groups..., y_true, y_score[, y_pred])``.  Everything that
depends on the order of scores first reduces the rows to a histogram of
distinct scores, then uses ``running_totals``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.ranking import running_totals
from textloom.session import broadcast_checked


def on_groups(left: DataFrame, right: DataFrame, groups: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two per-group results; without groups both have one row."""
    if not groups:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({g: f"__right_{g}" for g in groups})
    match = F.lit(True)
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"__right_{g}"))
    return left.join(renamed, match, how).drop(*[f"__right_{g}" for g in groups])


def predict(score: Column, threshold: Column | float, less_than: bool = False) -> Column:
    """1 when ``score >= threshold``, flipped when low scores are positive."""
    hit = score >= threshold
    return (~hit if less_than else hit).cast("int")


def confusion(y_true: Column, y_pred: Column) -> dict[str, Column]:
    """Aggregates tn, fp, fn, tp."""
    return {
        name: F.count_if((y_true == t) & (y_pred == p)).alias(name)
        for name, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    }


def confusion_at(
    df: DataFrame, groups: Sequence[str], thresholds: Mapping[str, float], less_than: bool = False
) -> DataFrame:
    """(groups, model, tn, fp, fn, tp) for a fixed list of models, in one pass."""
    cells = []
    for model, threshold in thresholds.items():
        pred = predict(F.col("y_score"), F.lit(threshold), less_than)
        counts = confusion(F.col("y_true"), pred)
        cells.append(F.struct(F.lit(model).alias("model"), *counts.values()).alias(f"c_{model}"))
    wide = df.groupBy(*groups).agg(*cells)
    return wide.select(*groups, F.inline(F.array(*[F.col(f"c_{m}") for m in thresholds])))


def _share(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    return F.when(bottom == 0, F.lit(empty).cast("double")).otherwise(top / bottom)


def metrics_from_confusion(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Support-weighted precision, recall and F1 (0 when undefined), accuracy,
    error rates (NULL without the class) and the F1 of each class."""
    human, ai = tn + fp, fn + tp
    n = human + ai
    f1_human = _share(2 * tn, 2 * tn + fp + fn)
    f1_ai = _share(2 * tp, 2 * tp + fp + fn)

    def weighted(of_human: Column, of_ai: Column) -> Column:
        return (human * of_human + ai * of_ai) / n

    return {
        "f1_score": weighted(f1_human, f1_ai),
        "precision": weighted(_share(tn, tn + fn), _share(tp, tp + fp)),
        "recall": weighted(_share(tn, human), _share(tp, ai)),
        "accuracy": (tn + tp) / n,
        "fpr": _share(fp, human, None),
        "tpr": _share(tp, ai, None),
        "f1_human": f1_human,
        "f1_ai": f1_ai,
    }


def score_counts(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Histogram of distinct scores with the class counts (map-side combined)."""
    return df.groupBy(*groups, "y_score").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")
    )


def auroc(
    df: DataFrame,
    groups: Sequence[str] = (),
    less_than: bool = False,
    single_class: float | None = None,
) -> DataFrame:
    """(groups, roc_auc) by rank sums, ties averaged.

    Rescaling the scores does not change ranks, so none is needed.  A group
    with a single class gives ``single_class``.  Products are summed as
    doubles: at 10^11 rows the pair count exceeds 64 bits.
    """
    placed = running_totals(
        score_counts(df, groups), ["y_score"], {"neg_before": F.col("neg")}, keys=groups
    )
    wins = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2)
    sums = placed.groupBy(*groups).agg(
        F.sum(wins).alias("__wins"), F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg")
    )
    area = F.col("__wins") / (F.col("__pos").cast("double") * F.col("__neg"))
    area = 1 - area if less_than else area
    both = (F.col("__pos") > 0) & (F.col("__neg") > 0)
    return sums.select(
        *groups, F.when(both, area).otherwise(F.lit(single_class)).alias("roc_auc")
    )


def binary_metrics(
    df: DataFrame,
    groups: Sequence[str] = (),
    threshold: float = 0.5,
    less_than: bool = False,
    suffix: str = "",
) -> DataFrame:
    """One row per group; a ``y_pred`` column, where present, beats the threshold."""
    pred = (
        F.col("y_pred")
        if "y_pred" in df.columns
        else predict(F.col("y_score"), F.lit(threshold), less_than)
    )
    counts = df.groupBy(*groups).agg(*confusion(F.col("y_true"), pred).values())
    cells = [F.col(c) for c in ("tn", "fp", "fn", "tp")]
    measured = counts.select(
        *groups, *[c.alias(f"{m}{suffix}") for m, c in metrics_from_confusion(*cells).items()]
    )
    area = auroc(df, groups, less_than).withColumnRenamed("roc_auc", f"roc_auc{suffix}")
    return on_groups(measured, area, groups)


def order_statistics(
    df: DataFrame,
    value: str,
    ranks: Mapping[str, Column],
    groups: Sequence[str] = (),
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Exact values at 0-based ranks.  ``ranks`` may use ``n`` (rows of the
    group) and the extra aggregates named in ``totals``."""
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("__c"))
    placed = running_totals(counted, [value], {"__before": F.col("__c")}, keys=groups)
    sizes = df.groupBy(*groups).agg(
        F.count("*").alias("n"), *[c.alias(t) for t, c in (totals or {}).items()]
    )
    joined = on_groups(placed, sizes, groups)

    def at(rank: Column) -> Column:
        here = (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__c"))
        return F.max(F.when(here, F.col(value)))

    return joined.groupBy(*groups).agg(
        F.max("n").alias("n"), *[at(rank).alias(name) for name, rank in ranks.items()]
    )


def exact_quantile(df: DataFrame, value: str, q: float, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n, quantile) with linear interpolation between neighbours."""
    position = F.lit(q) * (F.col("n") - 1)
    found = order_statistics(
        df, value, {"__low": F.floor(position), "__high": F.ceil(position)}, groups
    )
    low, high = F.col("__low").cast("double"), F.col("__high").cast("double")
    return found.select(
        *groups, "n", (low + (high - low) * (position - F.floor(position))).alias("quantile")
    )


def threshold_mean_midpoint(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Middle between the mean scores of the two classes."""
    human = F.avg(F.when(F.col("y_true") == 0, F.col("y_score")))
    ai = F.avg(F.when(F.col("y_true") == 1, F.col("y_score")))
    return df.groupBy(*groups).agg(
        human.alias("mean_human"), ai.alias("mean_ai"), ((human + ai) / 2).alias("threshold_mean")
    )


def threshold_median(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Median of all scores, only for groups whose classes have equal size."""
    balance = F.sum(F.when(F.col("y_true") == 1, 1).otherwise(-1)).alias("__balance")
    balanced = df.groupBy(*groups).agg(balance)
    median = exact_quantile(df, "y_score", 0.5, groups).withColumnRenamed("quantile", "__median")
    return on_groups(median, balanced, groups).select(
        *groups, F.when(F.col("__balance") == 0, F.col("__median")).alias("threshold_median")
    )


def threshold_calibrated(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Score at ascending rank ``n - positives - 1``."""
    found = order_statistics(
        df,
        "y_score",
        {"threshold_calibrated": F.col("n") - F.col("__pos") - 1},
        groups,
        totals={"__pos": F.sum("y_true")},
    )
    return found.drop("n")


def threshold_at_fpr(
    df: DataFrame, groups: Sequence[str] = (), target: float = 0.05, less_than: bool = False
) -> DataFrame:
    """(groups, threshold_fpr): the exact cut on the human scores.

    Of all scores, the one whose false positive rate is the largest that does
    not exceed ``target``; if every rate does, the one with the smallest rate.
    One histogram and one running total; nothing reaches the driver.
    """
    groups = list(groups)
    human = df.where(F.col("y_true") == 0).groupBy(*groups, "y_score").agg(F.count("*").alias("c"))
    order = F.col("y_score").asc() if less_than else F.col("y_score").desc()
    placed = running_totals(human, [order], {"__before": F.col("c")}, keys=groups)
    sizes = human.groupBy(*groups).agg(F.sum("c").alias("__n"))
    hits = F.col("__before") if less_than else F.col("__before") + F.col("c")
    rate = hits / F.col("__n")
    cut = F.struct(rate.alias("rate"), "y_score")
    return on_groups(placed, sizes, groups).groupBy(*groups).agg(
        F.coalesce(F.max(F.when(rate <= target, cut)), F.min(cut))["y_score"].alias("threshold_fpr")
    )


def evaluation_report(
    df: DataFrame,
    groups: Sequence[str] = (),
    threshold: float = 0.5,
    sigmoid: bool = False,
    less_than: bool = False,
    predicted: str | None = None,
) -> DataFrame:
    """n, class counts, AUROC and the metrics at the given, the median, the
    mean-midpoint and the 5 % FPR threshold; one row per group.

    ``sigmoid`` takes y_score as logits, ``less_than`` says that low scores are
    positive, ``predicted`` names a column of given predictions that stand for
    those at ``threshold``.
    """
    groups = list(groups)
    if sigmoid:
        df = df.withColumn("y_score", 1.0 / (1.0 + F.exp(-F.col("y_score"))))
    cuts = threshold_mean_midpoint(df, groups).select(*groups, "threshold_mean")
    cuts = on_groups(cuts, threshold_median(df, groups), groups, "left")
    cuts = on_groups(cuts, threshold_at_fpr(df, groups, less_than=less_than), groups, "left")
    cuts = cuts.withColumn("threshold", F.lit(threshold))
    placed = on_groups(df, cuts, groups)
    named = {"": "threshold", "_median": "threshold_median", "_mean": "threshold_mean", "_fpr": "threshold_fpr"}
    cells = [
        F.count("*").alias("n_samples"),
        F.count_if(F.col("y_true") == 0).alias("n_samples_human"),
        F.count_if(F.col("y_true") == 1).alias("n_samples_ai"),
    ]
    for suffix, cut in named.items():
        if suffix:
            cells.append(F.max(cut).alias(cut))
        pred = predict(F.col("y_score"), F.col(cut), less_than)
        if predicted and not suffix:
            pred = F.col(predicted)
        cells += [c.alias(f"__{n}{suffix}") for n, c in confusion(F.col("y_true"), pred).items()]
    counted = placed.groupBy(*groups).agg(*cells)
    measures = []
    for suffix, cut in named.items():
        parts = [F.col(f"__{c}{suffix}") for c in ("tn", "fp", "fn", "tp")]
        defined = F.lit(True) if not suffix else F.col(cut).isNotNull()
        measures += [
            F.when(defined, c).alias(f"{m}{suffix}")
            for m, c in metrics_from_confusion(*parts).items()
        ]
    kept = [c for c in counted.columns if not c.startswith("__")]
    turned = df.withColumn("y_score", -F.col("y_score")) if less_than else df
    return on_groups(counted.select(*kept, *measures), auroc(turned, groups), groups)


def best_direction_scores(df: DataFrame, groups: Sequence[str], threshold: Column) -> DataFrame:
    """F1 and accuracy, the better of ``>`` and ``<``."""
    sides = {"above": F.col("y_score") > threshold, "below": F.col("y_score") < threshold}
    cells = [
        c.alias(f"{side}_{n}")
        for side, hit in sides.items()
        for n, c in confusion(F.col("y_true"), hit.cast("int")).items()
    ]
    counted = df.groupBy(*groups).agg(*cells)
    f1, accuracy = [], []
    for side in sides:
        tn, fp, fn, tp = (F.col(f"{side}_{c}") for c in ("tn", "fp", "fn", "tp"))
        f1.append(_share(2 * tp, 2 * tp + fp + fn))
        accuracy.append((tn + tp) / (tn + fp + fn + tp))
    return counted.select(*groups, F.greatest(*f1).alias("f1"), F.greatest(*accuracy).alias("accuracy"))


def multiclass_metrics(
    df: DataFrame,
    classes: Sequence[int],
    groups: Sequence[str] = (),
    min_samples: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(per class rows, macro rows) from ``y_true``, ``y_pred`` and the class
    scores ``y_proba`` (an array in the order of ``classes``).

    Rates with an empty base are 0.  AUROC is one-vs-rest over the classes
    that occur; groups with fewer than two classes get NULL.
    """
    groups = list(groups)
    cells = df.groupBy(*groups, "y_true", "y_pred").agg(F.count("*").alias("c"))
    labels = F.array(*[F.lit(int(c)) for c in classes])
    spread = cells.withColumn("class", F.explode(labels))
    is_true, is_pred = F.col("y_true") == F.col("class"), F.col("y_pred") == F.col("class")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("c")).otherwise(0))

    counted = spread.groupBy(*groups, "class").agg(
        total(is_true & is_pred).alias("tp"),
        total(~is_true & is_pred).alias("fp"),
        total(is_true & ~is_pred).alias("fn"),
        total(~is_true & ~is_pred).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    per_class = counted.where(tp + fp + fn + tn >= min_samples).select(
        *groups,
        "class",
        (tp + fp + fn + tn).alias("n"),
        (tp + fn).alias("support"),
        _share(tp, tp + fn).alias("tpr"),
        _share(fp, fp + tn).alias("fpr"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    one_vs_rest = df.select(*groups, "y_true", F.posexplode("y_proba").alias("__i", "y_score")).select(
        *groups,
        F.get(labels, F.col("__i")).alias("class"),
        (F.col("y_true") == F.get(labels, F.col("__i"))).cast("int").alias("y_true"),
        "y_score",
    )
    areas = auroc(one_vs_rest, [*groups, "class"])
    per_class = on_groups(per_class, areas, [*groups, "class"], "left")
    macro = per_class.groupBy(*groups).agg(
        F.max("n").alias("n"),
        F.avg("f1").alias("f1_macro"),
        F.when(F.count_if(F.col("support") > 0) >= 2, F.avg("roc_auc")).alias("auroc_macro"),
        F.avg("tpr").alias("tpr_macro"),
        F.avg("fpr").alias("fpr_macro"),
    )
    return per_class, macro


def score_histogram(df: DataFrame, groups: Sequence[str], bins: int) -> DataFrame:
    """Counts per group, class and bin of equal width between the group's
    smallest and largest score, with the class means as marks."""
    groups = list(groups)
    bounds = df.groupBy(*groups).agg(
        F.min("y_score").alias("low"),
        F.max("y_score").alias("high"),
        F.avg(F.when(F.col("y_true") == 0, F.col("y_score"))).alias("mean_human"),
        F.avg(F.when(F.col("y_true") == 1, F.col("y_score"))).alias("mean_ai"),
    )
    width = (F.col("high") - F.col("low")) / bins
    bin_no = F.when(width == 0, 0).otherwise(
        F.least(F.floor((F.col("y_score") - F.col("low")) / width), F.lit(bins - 1))
    )
    placed = on_groups(df, broadcast_checked(bounds), groups).withColumn("bin", bin_no.cast("int"))
    return placed.groupBy(*groups, "y_true", "bin").agg(
        F.count("*").alias("n"),
        F.min("mean_human").alias("mean_human"),
        F.min("mean_ai").alias("mean_ai"),
    )


def class_share(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Share of each class and the accuracy of always naming the larger one."""
    ai = F.avg(F.col("y_true").cast("double"))
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"),
        (1 - ai).alias("share_human"),
        ai.alias("share_ai"),
        F.greatest(ai, 1 - ai).alias("majority_accuracy"),
    )


def layer_correlation(df: DataFrame, column: str, layers: int) -> DataFrame:
    """(a, b, r): Pearson r of each pair of layers over all rows.

    Tasks sum products of whole batches; one row per pair and task is shuffled.
    NULL where a layer is constant.  Rows whose vector is null or of another
    length do not count.
    """
    first, second = np.triu_indices(layers, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(layers), np.zeros((layers, layers))
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, layers)
                n, sums, products = n + len(values), sums + values.sum(axis=0), products + values.T @ values
        squares = np.diag(products)
        columns = {
            "a": first, "b": second, "n": np.full(len(first), float(n)), "x": sums[first], "y": sums[second],
            "xx": squares[first], "yy": squares[second], "xy": products[first, second],
        }
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k in "ab" else pa.float64()) for k, v in columns.items()})

    vectors = df.where(F.size(column) == layers).select(F.col(column).cast("array<double>").alias("__v"))
    moments = ("n", "x", "y", "xx", "yy", "xy")
    found = vectors.mapInArrow(run, "a int, b int, " + ", ".join(f"{m} double" for m in moments))
    n, x, y, xx, yy, xy = (F.sum(m) for m in moments)
    spread = F.sqrt(F.greatest((n * xx - x * x) * (n * yy - y * y), F.lit(0.0)))
    return found.groupBy("a", "b").agg(F.try_divide(n * xy - x * y, spread).alias("r"))


def random_predictions(df: DataFrame, key: str, share: Column, seed: int = 0) -> DataFrame:
    """Add y_score, a draw in [0, 1) by a hash of the key, and y_pred: 1 for the share of rows with the smallest draws.

    The predictor knows the share of the classes and nothing else.
    """
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10)
    draw = digits.cast("double") / float(16**8)
    return df.withColumn("y_score", draw).withColumn("y_pred", (F.col("y_score") < share).cast("int"))
