"""Array features of the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import arrays as ar
from textloom.plans.registry import query, r6
from textloom.session import table

WHOLE = "list_transform(embedding, lambda x: x::DOUBLE)"


def vectors(spark, sf):
    """The vectors as doubles."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", "label", values.alias("v"))


def long_form(df, column: str, name: str = "value"):
    return df.select("vec_id", F.posexplode(column).alias("pos", name)).withColumn(name, r6(name))


def sql_long(expr: str, source: str = "embeddings") -> str:
    return f"""SELECT vec_id, (generate_subscripts(l, 1) - 1)::INT AS pos, round(unnest(l), 6) + 0.0::DOUBLE AS value
      FROM (SELECT vec_id, {expr} AS l FROM {source})"""


@query(
    "WN-13",
    sql="""SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i DESC) - 1)::INT AS pos, round(v, 6) + 0.0::DOUBLE AS value,
             i::BIGINT AS other FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i
             FROM embeddings)""",
)
def sort_arrays_by(spark, sf):
    pairs = vectors(spark, sf).withColumn("other", F.sequence(F.lit(0), F.size("v") - 1).cast("array<bigint>"))
    ordered = ar.sort_arrays_by(pairs.drop("label"), "v", "other", reverse=True)
    rows = ar.zip_features(ordered, ["v", "other"])
    return rows.select("vec_id", "pos", r6("v").alias("value"), "other")


@query(
    "WN-15",
    sql="""SELECT vec_id || '.' || h AS vec_id, label, CASE h WHEN 0 THEN len(embedding) // 2 ELSE len(embedding) - len(embedding) // 2 END AS n,
             round(list_sum(list_transform(CASE h WHEN 0 THEN embedding[1 : len(embedding) // 2]
               ELSE embedding[len(embedding) // 2 + 1 :] END, lambda x: x::DOUBLE)), 6) + 0.0::DOUBLE AS total
           FROM embeddings, (SELECT unnest([0, 1]) AS h)""",
)
def split_feature_rows(spark, sf):
    halves = ar.split_feature_rows(table(spark, sf, "embeddings"), "vec_id", ["embedding"])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return halves.select(
        "vec_id", "label", F.size("embedding").cast("bigint").alias("n"), r6(total).alias("total")
    )


RAGGED = "list_transform(embedding[1 : 48 + 4 * label], lambda x: x::DOUBLE)"


@query(
    "SC-19",
    sql=f"""SELECT vec_id, (generate_subscripts(l, 1) - 1)::INT AS pos, round(coalesce(unnest(l), 0), 6) + 0.0::DOUBLE AS value,
              generate_subscripts(l, 1) <= least(64, 48 + 4 * label) AS mask
            FROM (SELECT vec_id, label, list_resize({RAGGED}, 60) AS l FROM embeddings)""",
)
def pad_or_trim(spark, sf):
    """Vectors of 48 to 64 values brought to 60, with the mask of real entries."""
    ragged = vectors(spark, sf).withColumn("v", F.slice("v", F.lit(1), F.col("label") * 4 + 48))
    fixed = ragged.select(
        "vec_id",
        ar.pad_or_trim(F.col("v"), 60, F.lit(0.0)).alias("value"),
        ar.padding_mask(F.col("v"), 60).alias("mask"),
    )
    rows = ar.zip_features(fixed, ["value", "mask"])
    return rows.select("vec_id", "pos", r6("value").alias("value"), "mask")


@query(
    "SC-20",
    sql=sql_long(
        f"""list_transform({WHOLE}, lambda x: CASE WHEN x > 0.2 THEN 1.0::DOUBLE WHEN x < -0.2 THEN -1.0::DOUBLE
            WHEN abs(x) < 0.01 THEN 0.0::DOUBLE ELSE x END)"""
    ),
)
def nan_to_num(spark, sf):
    """Large values are made infinite and tiny ones NaN first."""

    def spoil(x):
        return (
            F.when(x > 0.2, float("inf")).when(x < -0.2, float("-inf"))
            .when(F.abs(x) < 0.01, float("nan")).otherwise(x)
        )

    spoiled = vectors(spark, sf).withColumn("v", F.transform("v", spoil))
    return long_form(spoiled.withColumn("v", F.transform("v", ar.nan_to_num)), "v")


@query("SC-21", sql=sql_long(f"list_transform({WHOLE}, lambda x: x * 2 - 1)"))
def rescale_features(spark, sf):
    return long_form(vectors(spark, sf).withColumn("v", F.transform("v", ar.rescale)), "v")


@query(
    "SC-22",
    sql=f"""SELECT *, 'delta' AS kind FROM ({sql_long(f"list_concat({WHOLE}, list_transform(({WHOLE})[2:], lambda x: x - embedding[1]::DOUBLE))")})
            UNION ALL SELECT *, 'product' FROM ({sql_long(f"list_concat({WHOLE}, list_transform(({WHOLE})[2:], lambda x: x * embedding[1]::DOUBLE))")})""",
)
def augment_layers(spark, sf):
    layers = vectors(spark, sf)
    delta = layers.withColumn("v", ar.augment_layers(F.col("v"), delta=True))
    product = layers.withColumn("v", ar.augment_layers(F.col("v"), product=True))
    return (
        long_form(delta, "v").withColumn("kind", F.lit("delta"))
        .unionByName(long_form(product, "v").withColumn("kind", F.lit("product")))
    )


@query(
    "SC-23",
    sql=f"""SELECT vec_id, round(1 / (1 + exp(-v[1])), 6) AS sigmoid,
              round(exp(v[2]) / list_sum(list_transform(v, lambda x: exp(x))), 6) AS class_1,
              (list_position(v, list_max(v)) - 1)::INT AS best FROM (SELECT vec_id, {WHOLE} AS v FROM embeddings)""",
)
def logit_transforms(spark, sf):
    layers = vectors(spark, sf)
    return layers.select(
        "vec_id",
        r6(ar.sigmoid(F.get("v", F.lit(0)))).alias("sigmoid"),
        r6(F.get(ar.softmax(F.col("v")), F.lit(1))).alias("class_1"),
        ar.argmax(F.col("v")).alias("best"),
    )


@query(
    "SC-24",
    sql="""SELECT doc_id, round((n_chars - min(n_chars) OVER ())::DOUBLE / (max(n_chars) OVER () - min(n_chars) OVER ()), 6) AS score
           FROM documents SEMI JOIN labels USING (doc_id)""",
)
def min_max_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labelled = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi")
    return ar.min_max_scores(labelled, "score").withColumn("score", r6("score"))


@query(
    "SC-25",
    sql="""SELECT label, dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) + 0.0::DOUBLE AS value FROM (
             SELECT label, (embedding[1] > 0)::INT::DOUBLE AS m, (generate_subscripts(embedding, 1) - 1)::INT AS dim,
               unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, dim""",
)
def mean_pool(spark, sf):
    pooled = ar.mean_pool(
        table(spark, sf, "embeddings"), "label", "embedding", F.get("embedding", F.lit(0)) > 0
    )
    return pooled.withColumn("value", r6("value"))


@query(
    "SC-28",
    sql="""SELECT vec_id, i::INT AS pos, round(embedding[i + 1]::DOUBLE, 6) + 0.0::DOUBLE AS a, round(embedding[i + 33]::DOUBLE, 6) + 0.0::DOUBLE AS b
           FROM embeddings, (SELECT unnest(range(32)) AS i)""",
)
def zip_feature_arrays(spark, sf):
    """Cut into two pieces, merged in order again, then zipped to rows."""
    pairs = table(spark, sf, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b")
    )
    pieces = pairs.select(
        "vec_id",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("piece"),
                        F.slice("a", 16 * i + 1, 16).alias("a"),
                        F.slice("b", 16 * i + 1, 16).alias("b"),
                    )
                    for i in (1, 0)
                ]
            )
        ),
    )
    rows = ar.zip_features(ar.merge_features(pieces, "vec_id", "piece", ["a", "b"]), ["a", "b"])
    return rows.withColumns({c: r6(c) for c in ("a", "b")})


@query(
    "SC-29",
    sql="""WITH s AS (SELECT vec_id, t, (embedding[t*4+1]::DOUBLE + embedding[t*4+2] + embedding[t*4+3] + embedding[t*4+4]) / 4 AS x
             FROM embeddings, (SELECT unnest(range(16)) AS t)),
           c AS (SELECT vec_id, t, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM s),
           f AS (SELECT unnest(range(1, 9)) AS k)
           SELECT vec_id, round(k / 16.0::DOUBLE, 6) AS frequency,
             round(pow(sum(x * cos(2 * pi() * k * t / 16)), 2) + pow(sum(x * sin(2 * pi() * k * t / 16)), 2), 6) + 0.0::DOUBLE AS power
           FROM c, f GROUP BY vec_id, k""",
)
def trajectory_spectrum(spark, sf):
    """Each vector as 16 tokens with 4 layer values."""
    matrix = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    windows = table(spark, sf, "embeddings").select("vec_id", matrix.alias("m"))
    return ar.trajectory_spectrum(windows, "vec_id", "m").withColumns(
        {"frequency": r6("frequency"), "power": r6("power")}
    )
