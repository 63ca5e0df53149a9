"""Spark ML detectors on the text statistics and the vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from textloom.functions.statistics import METRICS, with_text_metrics
from textloom.operators import boosting, convolution as cv, epochs, evaluation as ev, likelihood as lm, models as md, search
from textloom.operators.splits import with_part
from textloom.plans.registry import corpus, query, r6
from textloom.plans.row_queries import hash_split
from textloom.plans.text_queries import metrics_sql
from textloom.session import materialize, scratch_path, table


def features(spark, sf, labelled: bool = True):
    """Statistics of the labelled documents, computed once and written."""
    docs = corpus(spark, sf, "lang", "source")
    if labelled:
        labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
        docs = docs.join(labels, "doc_id")
    rows = with_text_metrics(docs).drop("text").withColumn("split", hash_split())
    return materialize(rows, "features")


def rounded(df, *keep: str):
    return df.select(*keep, *[r6(c).alias(c) for c in df.columns if c not in keep])


def train_test(rows):
    return rows.where("split <> 'test'"), rows.where("split = 'test'")


@query(
    "ML-01",
    sql=f"""SELECT doc_id, 12 AS n, round({' + '.join(f'{m}::DOUBLE' for m in METRICS)}, 6) AS total
            FROM ({metrics_sql('documents')})""",
)
def assemble_features(spark, sf):
    rows = md.assembler(METRICS).transform(with_text_metrics(corpus(spark, sf)))
    values = vector_to_array("features")
    return rows.select(
        "doc_id",
        F.size(values).alias("n"),
        r6(F.aggregate(values, F.lit(0.0), lambda a, x: a + x)).alias("total"),
    )


@query(
    "ML-02",
    sql="SELECT doc_id, "
    + ", ".join(
        f"CASE WHEN stddev_pop({m}) OVER () = 0 THEN 0 ELSE round(({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER (), 6) END + 0.0::DOUBLE AS {m}"
        for m in METRICS
    )
    + f" FROM ({metrics_sql('documents')})",
)
def standardize(spark, sf):
    rows = with_text_metrics(corpus(spark, sf)).select("doc_id", *METRICS)
    return rounded(md.standardize(rows, METRICS), "doc_id")


@query("ML-03")
def logistic_multinomial(spark, sf):
    """Three classes (quality + toxic), evaluated overall and by language."""
    rows = features(spark, sf).withColumn("label", F.col("label") + F.col("toxic"))
    train, test = train_test(rows)
    predicted = md.logistic(METRICS).fit(train).transform(test)
    scored = predicted.select(
        "lang",
        F.col("label").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability").alias("y_proba"),
    )
    scored = materialize(scored, "scored")
    overall = ev.multiclass_metrics(scored.withColumn("part", F.lit("overall")), [0, 1, 2], ["part"])[1]
    by_lang = ev.multiclass_metrics(
        scored.withColumnRenamed("lang", "part"), [0, 1, 2], ["part"], min_samples=5
    )[1]
    return rounded(overall.unionByName(by_lang), "part", "n")


@query("ML-04")
def linear_threshold(spark, sf):
    train, test = train_test(features(spark, sf))
    apply = md.LinearThreshold(METRICS).fit(train)
    scored = apply(test).withColumn("y_true", F.col("label"))
    return rounded(ev.binary_metrics(scored.select("lang", "y_true", "y_score", "y_pred")))


@query("ML-05")
def boosted_trees(spark, sf):
    rows = features(spark, sf)
    train, test = train_test(rows)
    model = md.boosted_trees(METRICS, rounds=10, maxDepth=4).fit(train)
    return rounded(ev.binary_metrics(md.scored_rows(model.transform(test))))


@query("ML-05")
def boosted_trees_multiclass(spark, sf):
    rows = features(spark, sf).withColumn("label", F.col("label") + F.col("toxic"))
    train, test = train_test(rows)
    model = md.boosted_trees(METRICS, classes=3, rounds=5, maxDepth=3).fit(train)
    found = model.transform(test).select("label", F.col("prediction").cast("int").alias("y_pred"))
    return found.groupBy("label", "y_pred").agg(F.count("*").alias("n"))


@query("ML-05")
def softmax_boosting(spark, sf):
    """Three classes in one model; the loss is the mean -ln of the probability of the true class."""
    rows = features(spark, sf).withColumn("label", F.col("label") + F.col("toxic"))
    train, test = train_test(rows)
    model = boosting.fit_softmax_trees(train, METRICS, classes=3, rounds=30, depth=3, rate=0.2, bins=32)
    found = model.transform(test.select("label", *METRICS))
    loss = -F.ln(F.element_at("y_proba", F.col("label").cast("int") + 1))
    return found.groupBy("label", "y_pred").agg(F.count("*").alias("n"), r6(F.avg(loss)).alias("loss"))


@query("ML-06")
def embedding_classifier(spark, sf):
    rows = md.embedding_vectors(table(spark, sf, "embeddings"), "embedding")
    rows = rows.withColumn("split", hash_split("vec_id"))
    train, test = train_test(rows)
    predicted = md.embedding_classifier(maxIter=30).fit(train).transform(test)
    scored = predicted.select(
        F.col("label").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability").alias("y_proba"),
    )
    return rounded(ev.multiclass_metrics(materialize(scored, "scored"), list(range(10)))[1], "n")


@query("ML-07")
def sequence_feature_classifier(spark, sf):
    """Likelihood matrices of three orders, brought to 128 positions and flattened."""
    docs = corpus(spark, sf)
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    matrix = lm.likelihood_matrix(lm.token_likelihoods(docs))
    vector = md.flatten_matrix(F.col("intermediate_likelihoods"), length=128, layers=3)
    # The join moves the vectors, which are bounded, and not the matrices.
    rows = matrix.select("doc_id", vector.alias("features")).join(labels, "doc_id")
    rows = rows.select("doc_id", "label", "features", hash_split().alias("split"))
    train, test = train_test(materialize(rows, "matrices"))
    model = md.sequence_classifier(inputs=384, rounds=30).fit(train)
    return rounded(ev.binary_metrics(md.scored_rows(model.transform(test))))


@query("ML-07")
def sequence_convolution(spark, sf):
    """Kernels over the whole likelihood matrices of any length, then a linear model."""
    likelihoods = lm.token_likelihoods(corpus(spark, sf))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    moments = cv.layer_moments(likelihoods, [f"p{o}" for o in lm.ORDERS])
    matrix = lm.likelihood_matrix(likelihoods)
    # The join moves the kernels, whose number is fixed, and not the matrices.
    kernels = cv.with_pooled_kernels(matrix, "intermediate_likelihoods", *moments).join(labels, "doc_id")
    kernels = kernels.select("doc_id", "label", hash_split().alias("split"), array_to_vector("kernels").alias("raw_features"))
    rows = materialize(kernels, "kernels")
    train, test = train_test(rows)
    model = md.embedding_classifier(maxIter=30, regParam=0.01).fit(train)
    return rounded(ev.binary_metrics(md.scored_rows(model.transform(test))))


@query("ML-08")
def cross_validate(spark, sf):
    rows = with_part(features(spark, sf), "doc_id", 3, out="fold")
    return rounded(md.cross_validate(rows, "fold", range(3), md.logistic(METRICS, maxIter=20)), "fold", "part")


@query("ML-09")
def hyperparameter_search(spark, sf):
    rows = materialize(with_part(features(spark, sf), "doc_id", 2, out="fold"), "folds")
    estimator = LogisticRegression(family="multinomial", maxIter=15)
    pipeline = md.scaled_pipeline(METRICS, estimator)
    grid = {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 0.5]}
    best = md.hyperparameter_search(rows, "fold", 2, pipeline, estimator, grid)
    trials = [
        (*[float(params[estimator.getParam(p)]) for p in grid], float(score))
        for params, score in zip(best.getEstimatorParamMaps(), best.avgMetrics)
    ]
    return spark.createDataFrame(trials, "reg double, elastic double, f1 double")


@query("ML-09")
def adaptive_search(spark, sf):
    """Fifty trials of learning rate and penalty; every rung is a few passes for all its trials."""
    rows = md.standardize(features(spark, sf).withColumn("held", F.col("split") == "eval"), METRICS)
    train = materialize(rows.where("split <> 'test'").select("label", "held", *METRICS), "train")
    space = {"rate": search.Range(0.003, 1.0, log=True), "l2": search.Range(1e-6, 0.1, log=True)}
    objective = search.logistic_objective(train, METRICS, "label", "held")
    done = search.search(spark, space, objective, trials=50, bracket=10, path=scratch_path(spark, "trials"))
    rows = [(t.trial, t.rung, t.budget, t.params["rate"], t.params["l2"], t.score) for t in done]
    return rounded(spark.createDataFrame(rows, "trial int, rung int, budget int, rate double, l2 double, score double"), "trial", "rung", "budget")


@query("ML-10")
def leave_one_domain_out(spark, sf):
    rows = features(spark, sf).withColumn("held_out", F.col("split") == "test")
    estimator = md.logistic(METRICS, maxIter=20)
    domains = [r["lang"] for r in rows.where("lang IS NOT NULL").select("lang").distinct().orderBy("lang").collect()]
    return rounded(
        md.leave_one_domain_out(rows, "lang", domains, "held_out", estimator), "domain", "setting"
    )


@query("JN-09")
def cross_evaluate_models(spark, sf):
    """A model fitted on each language, with all metrics on every language."""
    rows = features(spark, sf).withColumn("held_out", F.col("split") == "test")
    found = md.cross_evaluate(rows, "lang", "held_out", md.logistic(METRICS, maxIter=20))
    return rounded(found, "model", "dataset")


@query(
    "ML-11",
    sql="""SELECT doc_id, round(1.0::DOUBLE / count(*) OVER (PARTITION BY quality), 6) AS weight FROM labels""",
)
def class_weighting(spark, sf):
    weighted = md.class_weights(table(spark, sf, "labels"), "quality")
    return weighted.select("doc_id", r6("weight").alias("weight"))


@query("ML-11")
def weighted_logistic(spark, sf):
    train, test = train_test(md.class_weights(features(spark, sf)))
    model = md.logistic(METRICS, weight="weight", maxIter=30).fit(train)
    return rounded(ev.binary_metrics(md.scored_rows(model.transform(test))))


@query("ML-12")
def early_stop(spark, sf):
    rows = features(spark, sf).withColumn("held", F.col("split") == "eval")
    train, test = train_test(rows)
    model = md.early_stopped_trees(METRICS, "held", rounds=20).fit(train)
    metrics = ev.binary_metrics(md.scored_rows(model.transform(test)))
    return rounded(metrics.withColumn("rounds", F.lit(model.stages[-1].getNumTrees)), "rounds")


@query("ML-12")
def patient_training(spark, sf):
    """Loss of every epoch; the best one is kept when the evaluation loss has stopped to fall."""
    rows = md.standardize(features(spark, sf).withColumn("held", F.col("split") == "eval"), METRICS)
    train = materialize(rows.where("split <> 'test'").select("label", "held", *METRICS), "train")
    found = epochs.train_with_patience(train, METRICS, "label", "held", epochs=60, patience=3, rate=0.3)
    trace = spark.createDataFrame(found.trace, "epoch int, train_loss double, eval_loss double")
    return rounded(trace.withColumn("best", F.col("epoch") == found.best_epoch), "epoch", "best")


@query("ML-13")
def save_load_model(spark, sf):
    """Scores of the stored model next to those of the fitted one."""
    train, test = train_test(features(spark, sf))
    model: Pipeline = md.logistic(METRICS, maxIter=20).fit(train)
    path = scratch_path(spark, "model")
    md.save_model(model, path)
    before = md.scored_rows(model.transform(test)).select("doc_id", F.col("y_score").alias("fitted"))
    after = md.scored_rows(md.load_model(path).transform(test)).select(
        "doc_id", F.col("y_score").alias("loaded")
    )
    return before.join(after, "doc_id").select(
        "doc_id", r6("fitted").alias("fitted"), r6("loaded").alias("loaded")
    )
