"""Detectors on table features with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.arrays import pad_or_trim
from textloom.operators.evaluation import binary_metrics, on_groups
from textloom.session import materialize


def assembler(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep")


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation per column (0 when constant).

    The scaler of Spark ML divides by the sample deviation; as a pipeline stage
    it differs from this by the factor sqrt((n - 1) / n).
    """
    df = materialize(df, "standardize")  # used twice, and the columns may be dear
    moments = df.agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns],
    )
    joined = df.crossJoin(F.broadcast(moments))  # exactly one row
    scaled = {
        c: F.when(F.col(f"__s_{c}") == 0, 0.0).otherwise(
            (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")
        )
        for c in columns
    }
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def scaled_pipeline(columns: Sequence[str], estimator: Estimator) -> Pipeline:
    """Assemble, scale, fit."""
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[assembler(columns, "raw_features"), scaler, estimator])


def logistic(columns: Sequence[str], weight: str | None = None, **params) -> Pipeline:
    """Multinomial logistic regression on scaled columns."""
    estimator = LogisticRegression(family="multinomial", **{"maxIter": 100, **params})
    return scaled_pipeline(columns, estimator.setWeightCol(weight) if weight else estimator)


class LinearThreshold:
    """Least squares on 0/1 labels; the score is clipped to [0, 1] and cut at 0.5."""

    def __init__(self, columns: Sequence[str]):
        self.pipeline = Pipeline(
            stages=[assembler(columns), LinearRegression(predictionCol="raw_score", solver="normal")]
        )

    def fit(self, df: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = self.pipeline.fit(df)

        def apply(rows: DataFrame) -> DataFrame:
            score = F.least(F.greatest(F.col("raw_score"), F.lit(0.0)), F.lit(1.0))
            return model.transform(rows).withColumn("y_score", score).withColumn(
                "y_pred", (F.col("y_score") >= 0.5).cast("int")
            )

        return apply


def boosted_trees(columns: Sequence[str], classes: int = 2, rounds: int = 400, **params) -> Pipeline:
    """Gradient-boosted trees; more than two classes as one-vs-rest."""
    trees = GBTClassifier(maxIter=rounds, seed=42, **params)
    return Pipeline(stages=[assembler(columns), trees if classes == 2 else OneVsRest(classifier=trees)])


def embedding_vectors(df: DataFrame, column: str, out: str = "raw_features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def embedding_classifier(**params) -> Pipeline:
    """Frozen vectors -> scaler -> logistic regression (input: raw_features)."""
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, LogisticRegression(**params)])


def flatten_matrix(matrix: Column, length: int, layers: int) -> Column:
    """Likelihood matrix -> vector of ``length * layers`` values: padded with
    zero rows or cut, missing values 0."""
    zero = F.array_repeat(F.lit(0.0), layers)
    fixed = F.flatten(pad_or_trim(matrix, length, zero))
    return array_to_vector(F.transform(fixed, lambda x: F.coalesce(x, F.lit(0.0))))


def sequence_classifier(inputs: int, classes: int = 2, hidden: int = 16, rounds: int = 100):
    return MultilayerPerceptronClassifier(layers=[inputs, hidden, classes], maxIter=rounds, seed=42)


def scored_rows(predictions: DataFrame) -> DataFrame:
    """Model output -> y_true, y_score (probability of class 1), y_pred."""
    score = (
        F.get(vector_to_array("probability"), F.lit(1))
        if "probability" in predictions.columns
        else F.col("prediction")
    )
    return predictions.withColumns(
        {
            "y_true": F.col("label").cast("int"),
            "y_score": score,
            "y_pred": F.col("prediction").cast("int"),
        }
    )


def cross_validate(
    df: DataFrame,
    fold: str,
    folds: Sequence[int],
    estimator: Estimator,
    unmatched: DataFrame | None = None,
) -> DataFrame:
    """(fold, part, metrics): fit on all other folds, score the fold itself and
    the unmatched rows.  The few folds are a plain loop; each fit is a Spark job."""
    whole = None
    for i in folds:
        model = estimator.fit(df.where(F.col(fold) != i))
        parts = {"test": df.where(F.col(fold) == i)}
        if unmatched is not None:
            parts["unmatched"] = unmatched
        for part, rows in parts.items():
            metrics = binary_metrics(scored_rows(model.transform(rows))).select(
                F.lit(i).alias("fold"), F.lit(part).alias("part"), "*"
            )
            whole = metrics if whole is None else whole.unionByName(metrics)
    return whole


def hyperparameter_search(
    df: DataFrame,
    fold: str,
    folds: int,
    pipeline: Pipeline,
    estimator: Estimator,
    grid: Mapping[str, Sequence],
    parallelism: int = 2,
) -> CrossValidatorModel:
    """Best mean F1 over given folds; trials run in parallel."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=builder.build(),
        evaluator=MulticlassClassificationEvaluator(metricName="f1"),
        numFolds=folds,
        foldCol=fold,
        parallelism=parallelism,
    )
    return search.fit(df)


def leave_one_domain_out(
    df: DataFrame, domain: str, domains: Sequence[str], held_out: str, estimator: Estimator
) -> DataFrame:
    """(domain, setting, metrics): trained on the domain itself or on all others,
    tested on the domain's held-out rows (``held_out`` is a boolean column)."""
    whole = None
    for name in domains:
        inside, test = F.col(domain) == name, F.col(held_out)
        for setting, rows in (("in_domain", df.where(inside & ~test)), ("others", df.where(~inside & ~test))):
            model = estimator.fit(rows)
            scored = scored_rows(model.transform(df.where(inside & test)))
            metrics = binary_metrics(scored).select(
                F.lit(name).alias("domain"), F.lit(setting).alias("setting"), "*"
            )
            whole = metrics if whole is None else whole.unionByName(metrics)
    return whole


def cross_evaluate(
    df: DataFrame, dataset: str, held_out: str, estimator: Estimator, most: int = 100
) -> DataFrame:
    """(model, dataset, metrics): a model fitted on the rows of each data set, evaluated on the held-out rows of all.

    ``held_out`` is a boolean column.  More than ``most`` data sets are an error,
    as each is a fit.  The metrics of a model are written before the next fit, so
    the plan does not grow.  A data set whose training rows have one label has no model.
    """
    sides = df.where(f"NOT {held_out}").groupBy(dataset).agg(F.count_distinct("label").alias("n"))
    names = [r[0] for r in sides.where("n > 1").select(dataset).orderBy(dataset).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} data sets")
    test, whole = df.where(held_out), None
    for name in names:
        model = estimator.fit(df.where(F.col(dataset).eqNullSafe(F.lit(name)) & ~F.col(held_out)))
        scored = scored_rows(model.transform(test)).withColumn("dataset", F.col(dataset))
        metrics = binary_metrics(scored, ["dataset"]).select(F.lit(name).alias("model"), "*")
        metrics = materialize(metrics, "cross-evaluated")
        whole = metrics if whole is None else whole.unionByName(metrics)
    return whole


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight``, the inverse frequency of the row's class."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    return on_groups(df, counts, [label]).withColumn("weight", 1.0 / F.col("__n")).drop("__n")


def early_stopped_trees(columns: Sequence[str], validation: str, rounds: int, tolerance: float = 0.01):
    """Boosting stops when the error on the validation rows no longer falls."""
    trees = GBTClassifier(
        maxIter=rounds, seed=42, validationIndicatorCol=validation, validationTol=tolerance
    )
    return Pipeline(stages=[assembler(columns), trees])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> Transformer:
    return PipelineModel.load(path)
