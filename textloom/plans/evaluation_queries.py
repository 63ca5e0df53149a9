"""Detector evaluation on labelled documents and on the vector classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import evaluation as ev
from textloom.operators.ranking import with_rank
from textloom.plans.registry import SCORED, query, r6, scored
from textloom.plans.row_queries import SPLIT_SQL, hash_split
from textloom.session import table


def sql_share(top: str, bottom: str, empty: str = "0") -> str:
    return f"CASE WHEN ({bottom}) = 0 THEN {empty} ELSE ({top})::DOUBLE / ({bottom}) END"


def sql_metrics(suffix: str = "") -> str:
    """Metric columns from tn, fp, fn, tp."""
    f1h, f1a = sql_share("2*tn", "2*tn+fp+fn"), sql_share("2*tp", "2*tp+fp+fn")

    def weighted(human: str, ai: str) -> str:
        return f"((tn+fp)*({human}) + (fn+tp)*({ai})) / (tn+fp+fn+tp)::DOUBLE"

    columns = {
        "f1_score": weighted(f1h, f1a),
        "precision": weighted(sql_share("tn", "tn+fn"), sql_share("tp", "tp+fp")),
        "recall": weighted(sql_share("tn", "tn+fp"), sql_share("tp", "fn+tp")),
        "accuracy": "(tn+tp)::DOUBLE / (tn+fp+fn+tp)",
        "fpr": sql_share("fp", "tn+fp", "NULL"),
        "tpr": sql_share("tp", "fn+tp", "NULL"),
        "f1_human": f1h,
        "f1_ai": f1a,
    }
    return ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {m}{suffix}" for m, c in columns.items())


def sql_confusion(pred: str) -> str:
    return ", ".join(
        f"count(*) FILTER (y_true = {t} AND ({pred})::INT = {p}) AS {n}"
        for n, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    )


def sql_auroc(source: str, group: str | None = None, single: str = "NULL") -> str:
    """Average-rank AUROC."""
    by = f"PARTITION BY {group}" if group else ""
    lead = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""(SELECT {lead}CASE WHEN sum(y_true) = 0 OR sum(y_true) = count(*) THEN {single} ELSE
       (sum(CASE WHEN y_true = 1 THEN r ELSE 0 END) - sum(y_true) * (sum(y_true) + 1) / 2.0::DOUBLE)
        / (sum(y_true)::DOUBLE * (count(*) - sum(y_true))) END AS roc_auc
      FROM (SELECT *, rank() OVER ({by} ORDER BY y_score)
        + (count(*) OVER (PARTITION BY {lead} y_score) - 1) / 2.0::DOUBLE AS r FROM {source}) {tail})"""


@query("AG-10", sql=f"SELECT source, {sql_confusion('y_score >= 0.5')} FROM {SCORED} GROUP BY source")
def confusion_counts(spark, sf):
    pred = ev.predict(F.col("y_score"), 0.5)
    cells = ev.confusion(F.col("y_true"), pred).values()
    return scored(spark, sf).groupBy("source").agg(*cells)


@query(
    "AG-11",
    sql=f"""SELECT doc_id, (y_score >= 0.5)::INT AS above, 1 - (y_score >= 0.5)::INT AS below,
            (y_score > 0.5)::INT AS strictly FROM {SCORED}""",
)
def predict_at_threshold(spark, sf):
    score = F.col("y_score")
    return scored(spark, sf).select(
        "doc_id",
        ev.predict(score, 0.5).alias("above"),
        ev.predict(score, 0.5, less_than=True).alias("below"),
        (score > 0.5).cast("int").alias("strictly"),
    )


@query(
    "AG-12",
    sql=f"""SELECT lang, * EXCLUDE (lang), round(roc_auc, 6) + 0.0::DOUBLE AS roc_auc FROM (
              SELECT lang, {sql_metrics()} FROM (SELECT lang, {sql_confusion('y_score >= 0.5')} FROM {SCORED}
              GROUP BY lang)) JOIN (SELECT lang AS l2, roc_auc FROM {sql_auroc(SCORED, 'lang')}) ON lang = l2""".replace(
        "SELECT lang, * EXCLUDE (lang), round", "SELECT * EXCLUDE (l2, roc_auc), round"
    ),
)
def binary_metrics(spark, sf):
    measured = ev.binary_metrics(scored(spark, sf), ["lang"])
    return measured.select("lang", *[r6(c).alias(c) for c in measured.columns if c != "lang"])


@query(
    "AG-13",
    sql=f"""SELECT source, round(roc_auc, 6) + 0.0::DOUBLE AS roc_auc,
              CASE WHEN roc_auc = -1 THEN -1 ELSE round(1 - roc_auc, 6) + 0.0::DOUBLE END AS roc_auc_flipped
            FROM {sql_auroc(SCORED, 'source', '-1')}""",
)
def auroc_by_source(spark, sf):
    rows = scored(spark, sf)
    plain = ev.auroc(rows, ["source"], single_class=-1.0)
    flipped = ev.auroc(rows, ["source"], less_than=True, single_class=-1.0)
    return plain.join(flipped.withColumnRenamed("roc_auc", "flipped"), "source").select(
        "source", r6("roc_auc").alias("roc_auc"), r6("flipped").alias("roc_auc_flipped")
    )


BALANCED = f"""(SELECT *, lang || '-' || CASE WHEN r <= m THEN 'even' ELSE 'rest' END AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, y_true ORDER BY doc_id) AS r,
    least(count(*) FILTER (y_true = 0) OVER (PARTITION BY lang),
          count(*) FILTER (y_true = 1) OVER (PARTITION BY lang)) AS m FROM {SCORED}))"""


@query(
    "AG-14",
    sql=f"""SELECT part, CASE WHEN sum(y_true) * 2 = count(*) THEN round(median(y_score), 6) + 0.0::DOUBLE END
            AS threshold_median FROM {BALANCED} GROUP BY part""",
)
def threshold_median(spark, sf):
    """Balanced parts (equal classes) get a threshold, the remainders none."""
    rows = scored(spark, sf)
    ranked = with_rank(rows, ["doc_id"], keys=["lang", "y_true"])
    smaller = rows.groupBy("lang").agg(
        F.least(F.sum("y_true"), F.sum(1 - F.col("y_true"))).alias("m")
    )
    kind = F.when(F.col("rank") < F.col("m"), "even").otherwise("rest")
    parted = ranked.join(smaller, "lang").withColumn("part", F.concat_ws("-", "lang", kind))
    cut = ev.threshold_median(parted, ["part"])
    return cut.select("part", r6("threshold_median").alias("threshold_median"))


@query(
    "AG-15",
    sql=f"""SELECT source, round(avg(y_score) FILTER (y_true = 0), 6) AS mean_human,
              round(avg(y_score) FILTER (y_true = 1), 6) AS mean_ai,
              round((avg(y_score) FILTER (y_true = 0) + avg(y_score) FILTER (y_true = 1)) / 2, 6) AS threshold_mean
            FROM {SCORED} GROUP BY source""",
)
def threshold_mean_midpoint(spark, sf):
    cut = ev.threshold_mean_midpoint(scored(spark, sf), ["source"])
    return cut.select("source", *[r6(c).alias(c) for c in cut.columns if c != "source"])


CALIBRATED = f"""(SELECT lang, max(y_score) FILTER (k = n - pos - 1) AS cut FROM (
   SELECT lang, y_score, row_number() OVER (PARTITION BY lang ORDER BY y_score) - 1 AS k,
     count(*) OVER (PARTITION BY lang) AS n, sum(y_true) OVER (PARTITION BY lang) AS pos FROM {SCORED}) GROUP BY lang)"""


@query("AG-16", sql=f"SELECT lang, round(cut, 6) AS threshold_calibrated FROM {CALIBRATED}")
def threshold_calibrated(spark, sf):
    cut = ev.threshold_calibrated(scored(spark, sf), ["lang"])
    return cut.select("lang", r6("threshold_calibrated").alias("threshold_calibrated"))


@query(
    "AG-17",
    sql=f"""WITH r AS (SELECT y_score, sum(c) OVER (ORDER BY y_score DESC)::DOUBLE / (sum(c) OVER ())::DOUBLE AS rate
        FROM (SELECT y_score, count(*) AS c FROM {SCORED} WHERE y_true = 0 GROUP BY y_score))
      SELECT round(coalesce(arg_max(y_score, rate) FILTER (rate <= 0.05::DOUBLE), arg_min(y_score, rate)), 4) AS threshold_fpr
      FROM r""",
)
def threshold_at_fpr(spark, sf):
    cut = ev.threshold_at_fpr(scored(spark, sf))
    return cut.select(F.round("threshold_fpr", 4).alias("threshold_fpr"))


def sql_report(source: str = SCORED, less_than: bool = False, given: str | None = None) -> str:
    """Thresholds per language, then the metrics at each of them."""
    falls, before = ("", "- c") if less_than else ("DESC", "")
    turned = f"(SELECT lang, y_true, -y_score AS y_score FROM {source})" if less_than else source

    def at(suffix: str, cut: str) -> str:
        hits = sql_confusion(given if given and not suffix else f"(y_score {'<' if less_than else '>='} {cut})")
        return f"""(SELECT lang AS l{suffix}, {sql_metrics(suffix)} FROM (SELECT lang, {hits}
          FROM {source} JOIN cuts USING (lang) WHERE {cut} IS NOT NULL GROUP BY lang))"""

    return f"""WITH r AS (SELECT lang, y_score, (sum(c) OVER (PARTITION BY lang ORDER BY y_score {falls}) {before})::DOUBLE
          / (sum(c) OVER (PARTITION BY lang))::DOUBLE AS rate
        FROM (SELECT lang, y_score, count(*) AS c FROM {source} WHERE y_true = 0 GROUP BY ALL)),
      fpr AS (SELECT lang, coalesce(arg_max(y_score, rate) FILTER (rate <= 0.05::DOUBLE), arg_min(y_score, rate)) AS thr
        FROM r GROUP BY lang),
      cuts AS (SELECT lang, 0.5::DOUBLE AS threshold, threshold_mean, threshold_median, thr AS threshold_fpr FROM (
        SELECT lang, (avg(y_score) FILTER (y_true = 0) + avg(y_score) FILTER (y_true = 1)) / 2 AS threshold_mean,
          CASE WHEN sum(y_true) * 2 = count(*) THEN median(y_score) END AS threshold_median FROM {source} GROUP BY lang)
        LEFT JOIN fpr USING (lang))
      SELECT lang, n_samples, n_samples_human, n_samples_ai, round(threshold_median, 6) AS threshold_median,
        round(threshold_mean, 6) AS threshold_mean, round(threshold_fpr, 6) AS threshold_fpr,
        a.* EXCLUDE (l), b.* EXCLUDE (l_median), c.* EXCLUDE (l_mean), d.* EXCLUDE (l_fpr),
        round(roc_auc, 6) + 0.0::DOUBLE AS roc_auc
      FROM (SELECT lang, count(*) AS n_samples, count(*) FILTER (y_true = 0) AS n_samples_human,
          count(*) FILTER (y_true = 1) AS n_samples_ai FROM {source} GROUP BY lang)
        JOIN cuts USING (lang) JOIN {at('', 'threshold')} a ON lang = l
        LEFT JOIN {at('_median', 'threshold_median')} b ON lang = l_median
        LEFT JOIN {at('_mean', 'threshold_mean')} c ON lang = l_mean
        LEFT JOIN {at('_fpr', 'threshold_fpr')} d ON lang = l_fpr
        JOIN (SELECT lang AS lr, roc_auc FROM {sql_auroc(turned, 'lang')}) ON lang = lr"""


@query("AG-18", sql=sql_report())
def evaluation_report(spark, sf):
    report = ev.evaluation_report(scored(spark, sf), ["lang"])
    return report.select(
        "lang",
        *[
            c if c.startswith("n_samples") else r6(c).alias(c)
            for c in report.columns
            if c != "lang"
        ],
    )


LOGITS = """(SELECT lang, quality AS y_true, 1.0::DOUBLE / (1.0::DOUBLE + exp(-ln((n_chars + 1) / 1000.0::DOUBLE))) AS y_score,
  (n_chars < 800)::INT AS y_given FROM documents JOIN labels USING (doc_id))"""


@query("AG-18", sql=sql_report(LOGITS, less_than=True, given="y_given"))
def evaluation_report_logits(spark, sf):
    """Logits of which low ones are positive, with given predictions beside them."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y_true"))
    rows = docs.join(labels, "doc_id").select(
        "lang", "y_true", F.ln((F.col("n_chars") + 1) / 1000.0).alias("y_score"), (F.col("n_chars") < 800).cast("int").alias("y_given")
    )
    report = ev.evaluation_report(rows, ["lang"], sigmoid=True, less_than=True, predicted="y_given")
    return report.select(
        "lang", *[c if c.startswith("n_samples") else r6(c).alias(c) for c in report.columns if c != "lang"]
    )


def _best(side: str) -> str:
    pred = f"y_score {side} 0.6"
    return f"SELECT lang, {sql_confusion(pred)} FROM {SCORED} GROUP BY lang"


@query(
    "AG-19",
    sql=f"""SELECT lang, round(max({sql_share('2*tp', '2*tp+fp+fn')}), 6) + 0.0::DOUBLE AS f1,
              round(max((tn+tp)::DOUBLE / (tn+fp+fn+tp)), 6) + 0.0::DOUBLE AS accuracy
            FROM ({_best('>')} UNION ALL {_best('<')}) GROUP BY lang""",
)
def best_direction_scores(spark, sf):
    best = ev.best_direction_scores(scored(spark, sf), ["lang"], F.lit(0.6))
    return best.select("lang", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"))


CLASSES = list(range(10))


def class_scores(spark, sf):
    """Vectors with their class and a score per class: the sum of every tenth of all
    their values, from the class's number on.  The arg max is the prediction."""
    value = F.col("embedding")
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda c: F.aggregate(
            F.filter(value, lambda _, i: F.pmod(i, F.lit(10)) == c), F.lit(0.0), lambda total, x: total + x.cast("double")
        ),
    )
    top = F.array_position("s", F.array_max("s")) - 1
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", scores.alias("s"))
    return vectors.select(
        "vec_id", F.col("label").alias("y_true"), top.cast("int").alias("y_pred"), F.col("s").alias("y_proba")
    )


VECTORS = """(SELECT vec_id, label AS y_true, list_position(s, list_max(s)) - 1 AS y_pred, s AS y_proba
  FROM (SELECT vec_id, label, list_transform(range(10), lambda c: list_reduce([0.0::DOUBLE] || list_filter(
    list_transform(embedding, lambda x: x::DOUBLE), lambda x, i: (i - 1) % 10 = c), lambda a, x: a + x)) AS s FROM embeddings))"""


@query("AG-10", sql=f"SELECT y_true, y_pred::INT AS y_pred, count(*) AS n FROM {VECTORS} GROUP BY ALL")
def confusion_matrix(spark, sf):
    return class_scores(spark, sf).groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def sql_multiclass(source: str, classes: list[int], group: str, minimum: int) -> str:
    """Per-class rows."""
    names = f"[{', '.join(map(str, classes))}]"
    one_vs_rest = f"""(SELECT {group} || '/' || class AS gc, (y_true = class)::INT AS y_true, y_score FROM (
      SELECT {group}, y_true, unnest({names}) AS class, unnest(y_proba) AS y_score FROM {source}))"""
    return f"""SELECT {group}, class::INT AS class, n, support,
       {sql_share('tp', 'support')} AS tpr, {sql_share('fp', 'n - support')} AS fpr,
       {sql_share('2*tp', 'support + tp + fp')} AS f1, roc_auc
     FROM (SELECT {group}, class, count(*) AS n, count(*) FILTER (y_true = class) AS support,
         count(*) FILTER (y_true = class AND y_pred = class) AS tp,
         count(*) FILTER (y_true <> class AND y_pred = class) AS fp
       FROM {source}, (SELECT unnest({names}) AS class) GROUP BY ALL HAVING count(*) >= {minimum})
     JOIN {sql_auroc(one_vs_rest, 'gc')} ON gc = {group} || '/' || class"""


ALL_VECTORS = f"(SELECT 'all' AS part, * FROM {VECTORS})"


@query(
    "AG-20",
    sql=f"""SELECT class, n, support, round(tpr, 6) + 0.0::DOUBLE AS tpr, round(fpr, 6) + 0.0::DOUBLE AS fpr,
            round(f1, 6) + 0.0::DOUBLE AS f1, round(roc_auc, 6) + 0.0::DOUBLE AS roc_auc
            FROM ({sql_multiclass(ALL_VECTORS, CLASSES, 'part', 0)})""",
)
def multiclass_per_class(spark, sf):
    per_class, _ = ev.multiclass_metrics(class_scores(spark, sf), CLASSES)
    return per_class.select(
        "class", "n", "support", *[r6(c).alias(c) for c in ("tpr", "fpr", "f1", "roc_auc")]
    )


MACRO = """max(n) AS n, round(avg(f1), 6) + 0.0::DOUBLE AS f1_macro,
  CASE WHEN count(*) FILTER (support > 0) >= 2 THEN round(avg(roc_auc), 6) + 0.0::DOUBLE END AS auroc_macro,
  round(avg(tpr), 6) + 0.0::DOUBLE AS tpr_macro, round(avg(fpr), 6) + 0.0::DOUBLE AS fpr_macro"""


@query("AG-20", sql=f"SELECT {MACRO} FROM ({sql_multiclass(ALL_VECTORS, CLASSES, 'part', 0)})")
def multiclass_macro(spark, sf):
    _, macro = ev.multiclass_metrics(class_scores(spark, sf), CLASSES)
    return macro.select("n", *[r6(c).alias(c) for c in macro.columns if c.endswith("_macro")])


THREE = """(SELECT lang, quality + toxic AS y_true,
   CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 3000 THEN 1 ELSE 2 END AS y_pred,
   [1000.0::DOUBLE / (n_chars + 1000), 0.5::DOUBLE, n_chars::DOUBLE / (n_chars + 1000)] AS y_proba
   FROM documents JOIN labels USING (doc_id))"""


def three_classes(spark, sf):
    n = F.col("n_chars")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    joined = docs.join(table(spark, sf, "labels"), "doc_id")
    return joined.select(
        "lang",
        (F.col("quality") + F.col("toxic")).alias("y_true"),
        F.when(n < 500, 0).when(n < 3000, 1).otherwise(2).alias("y_pred"),
        F.array(F.lit(1000.0) / (n + 1000), F.lit(0.5), n / (n + 1000)).alias("y_proba"),
    )


@query(
    "AG-21",
    sql=f"""SELECT lang, {MACRO} FROM ({sql_multiclass(THREE, [0, 1, 2], 'lang', 50)})
            GROUP BY lang ORDER BY max(n) DESC""",
)
def metrics_by_group_min_n(spark, sf):
    _, macro = ev.multiclass_metrics(three_classes(spark, sf), [0, 1, 2], ["lang"], min_samples=50)
    measured = macro.select("lang", "n", *[r6(c).alias(c) for c in macro.columns if c.endswith("_macro")])
    return measured.orderBy(F.desc("n"))


FOLDS = f"""(SELECT fold, {sql_metrics()} FROM (SELECT fold, {sql_confusion('y_score >= 0.5')} FROM (
   SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 1))::INT % 4 AS fold FROM {SCORED}) GROUP BY fold))"""


def fold_metrics(spark, sf):
    fold = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), 16, 10).cast("int") % 4
    rows = scored(spark, sf).withColumn("fold", fold)
    pred = ev.predict(F.col("y_score"), 0.5)
    counts = rows.groupBy("fold").agg(*ev.confusion(F.col("y_true"), pred).values())
    cells = [F.col(c) for c in ("tn", "fp", "fn", "tp")]
    return counts.select(
        "fold", *[r6(c).alias(m) for m, c in ev.metrics_from_confusion(*cells).items()]
    )


@query(
    "AG-22",
    sql=f"""SELECT metric, sum(round(value * 1000000)::BIGINT)::DOUBLE / (count(*) * 1000000)::DOUBLE AS mean, count(*) AS folds FROM
            (UNPIVOT {FOLDS} ON * EXCLUDE (fold) INTO NAME metric VALUE value) GROUP BY metric""",
)
def fold_average(spark, sf):
    folds = fold_metrics(spark, sf)
    metrics = [c for c in folds.columns if c != "fold"]
    tidy = folds.unpivot(["fold"], metrics, "metric", "value").where("value IS NOT NULL")
    # Whole millionths, so that the order of summation does not show.
    total = F.sum(F.round(F.col("value") * 1_000_000).cast("bigint"))
    return tidy.groupBy("metric").agg(
        (total.cast("double") / (F.count("*") * 1_000_000).cast("double")).alias("mean"), F.count("*").alias("folds")
    )


@query("AG-23", sql=f"SELECT fold, f1_score FROM {FOLDS} ORDER BY f1_score DESC, fold LIMIT 1")
def best_run(spark, sf):
    """Highest F1; the first fold wins a tie."""
    run = F.max_by(F.struct("fold", "f1_score"), F.struct("f1_score", -F.col("fold"))).alias("run")
    return fold_metrics(spark, sf).agg(run).select("run.*")


@query(
    "AG-28",
    sql=f"""SELECT split, count(*) AS n, round(1 - avg(y_true), 6) AS share_human, round(avg(y_true), 6) AS share_ai,
              round(greatest(avg(y_true), 1 - avg(y_true)), 6) AS majority_accuracy
            FROM (SELECT {SPLIT_SQL} AS split, y_true::DOUBLE AS y_true FROM {SCORED}) GROUP BY split""",
)
def class_share(spark, sf):
    rows = scored(spark, sf).withColumn("split", hash_split())
    share = ev.class_share(rows, ["split"])
    return share.select("split", "n", *[r6(c).alias(c) for c in share.columns[2:]])


@query(
    "AG-28",
    sql=f"""WITH s AS (SELECT doc_id, {SPLIT_SQL} AS split, y_true FROM {SCORED}),
            p AS (SELECT split, y_true, (('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE
              < avg(y_true) OVER (PARTITION BY split))::INT AS y_pred FROM s)
            SELECT split, count(*) AS n, count(*) FILTER (y_pred = 1) AS n_ai, round(avg((y_pred = y_true)::INT), 6) + 0.0::DOUBLE AS accuracy,
              round(CASE WHEN sum(y_pred) + sum(y_true) = 0 THEN NULL ELSE 2.0::DOUBLE * sum(y_pred * y_true) / (sum(y_pred) + sum(y_true)) END, 6) + 0.0::DOUBLE AS f1
            FROM p GROUP BY split""",
)
def random_predictor(spark, sf):
    """What a predictor reaches that draws by the share of the classes in each split."""
    rows = scored(spark, sf).drop("y_score").withColumn("split", hash_split())
    share = rows.groupBy("split").agg(F.avg("y_true").alias("share"))
    found = ev.random_predictions(ev.on_groups(rows, share, ["split"]), "doc_id", F.col("share"))
    both = F.sum(F.col("y_pred") * F.col("y_true"))
    return found.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("y_pred") == 1).alias("n_ai"),
        r6(F.avg((F.col("y_pred") == F.col("y_true")).cast("int"))).alias("accuracy"),
        r6(F.try_divide(2.0 * both, F.sum("y_pred") + F.sum("y_true"))).alias("f1"),
    )


@query(
    "AG-30",
    sql="""SELECT i::INT AS a, j::INT AS b, round(corr(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE), 6) + 0.0::DOUBLE AS r
           FROM embeddings, range(64) AS x(i), range(64) AS y(j) WHERE i < j GROUP BY i, j""",
)
def layer_correlation(spark, sf):
    pairs = ev.layer_correlation(table(spark, sf, "embeddings"), "embedding", layers=64)
    return pairs.withColumn("r", r6("r"))


@query(
    "AG-31",
    sql=f"""WITH b AS (SELECT lang, min(y_score) AS lo, (max(y_score) - min(y_score)) / 20 AS w,
              avg(y_score) FILTER (y_true = 0) AS h, avg(y_score) FILTER (y_true = 1) AS a
              FROM {SCORED} GROUP BY lang)
            SELECT lang, y_true, CASE WHEN w = 0 THEN 0 ELSE least(floor((y_score - lo) / w), 19) END::INT AS bin,
              count(*) AS n, round(any_value(h), 6) AS mean_human, round(any_value(a), 6) AS mean_ai
            FROM {SCORED} JOIN b USING (lang) GROUP BY lang, y_true, bin""",
)
def score_histogram(spark, sf):
    bins = ev.score_histogram(scored(spark, sf), ["lang"], bins=20)
    return bins.withColumns({c: r6(c) for c in ("mean_human", "mean_ai")})


@query(
    "AG-32",
    sql="""SELECT label < 5 AS low_class, count(*) AS n, round(quantile_cont(v::DOUBLE, 0.99), 6) AS quantile
           FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY ALL""",
)
def exact_quantile(spark, sf):
    values = table(spark, sf, "embeddings").select(
        (F.col("label") < 5).alias("low_class"), F.explode("embedding").alias("v")
    )
    found = ev.exact_quantile(values, "v", 0.99, ["low_class"])
    return found.withColumn("quantile", r6("quantile"))
