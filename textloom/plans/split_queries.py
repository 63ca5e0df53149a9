"""Stratified, matched and cross-validation splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import splits
from textloom.plans.join_queries import MATCHED
from textloom.plans.registry import SAMPLES, query, samples
from textloom.session import table


@query(
    "WN-08",
    sql="""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id)) - 1
             AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels),
           t AS (SELECT *, floor(n * 0.2 + 0.5) AS nt FROM r)
           SELECT doc_id, quality, CASE WHEN k < nt THEN 'test'
             WHEN k < nt + floor((n - nt) * 0.125 + 0.5) THEN 'eval' ELSE 'train' END AS split FROM t""",
)
def stratified_split(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return splits.stratified_split(labels, "doc_id", "quality")


@query(
    "WN-09",
    sql=f"""WITH m AS (SELECT id_source, row_number() OVER (ORDER BY md5('42:' || id_source)) - 1 AS k,
              count(*) OVER () AS n FROM {MATCHED}),
            p AS (SELECT id_source, CASE WHEN k < floor(n * (1.0::DOUBLE - 0.1 - 0.2)) THEN 'train'
              WHEN k < floor(n * (1.0::DOUBLE - 0.2)) THEN 'eval' ELSE 'test' END AS split FROM m)
            SELECT id_sample, coalesce(split, 'unmatched') AS split FROM {SAMPLES} LEFT JOIN p USING (id_source)
            WHERE split IS NULL OR agent IN ('human', 'assistant')""",
)
def matched_split(spark, sf):
    placed = splits.matched_split(samples(spark, sf), ["assistant"])
    return placed.select("id_sample", "split")


@query(
    "WN-10",
    sql=f"""WITH m AS (SELECT id_source, ntile(5) OVER (ORDER BY md5('42:' || id_source)) - 1 AS part FROM {MATCHED})
            SELECT id_source, fold, CASE (part - fold + 5) % 5 WHEN 0 THEN 'eval' WHEN 1 THEN 'test'
              WHEN 2 THEN 'test' ELSE 'train' END AS split FROM m, (SELECT unnest(range(5))::INT AS fold)""",
)
def cv_rotation(spark, sf):
    return splits.cv_rotation(samples(spark, sf), ["assistant"], parts=5)


@query(
    "WN-11",
    sql="SELECT doc_id, (ntile(4) OVER (ORDER BY md5('42:' || doc_id)) - 1)::INT AS fold FROM labels",
)
def kfold(spark, sf):
    return splits.with_part(table(spark, sf, "labels").select("doc_id"), "doc_id", 4, out="fold")


@query(
    "WN-12",
    sql="""SELECT conv_id FROM (SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || conv_id)) - 1 AS k,
             count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user'))
           WHERE k < floor(n * 0.8::DOUBLE)""",
)
def take_fraction_of_ids(spark, sf):
    human = table(spark, sf, "conversations").where("role = 'user'").select("conv_id").distinct()
    return splits.take_fraction(human, "conv_id", 0.8)
