"""Grouped lists, corpus statistics, distributions and sanity reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.statistics import METRICS, with_text_metrics
from textloom.functions.text import split_sentences, split_whitespace
from textloom.operators import groups
from textloom.plans.registry import SAMPLES, corpus, query, r6, samples
from textloom.plans.row_queries import SPLIT_SQL, hash_split
from textloom.plans.text_queries import SENTENCES_SQL, metrics_sql
from textloom.functions.patterns import SPACE
from textloom.session import table


@query(
    "AG-01",
    sql=f"""SELECT id_source, (k // 3) AS part, any_value(last_agent) AS agent,
              string_agg(id_sample, ',' ORDER BY turn) AS ids, string_agg(label, ',' ORDER BY turn) AS rest
            FROM (SELECT *, row_number() OVER (PARTITION BY id_source ORDER BY turn) - 1 AS k,
              last_value(agent) OVER (PARTITION BY id_source ORDER BY turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_agent FROM {SAMPLES})
            GROUP BY ALL""",
)
def group_documents(spark, sf):
    """Lists cut after three entries, to show how long ones continue."""
    turns = samples(spark, sf).drop("text")
    grouped = groups.group_documents(
        turns,
        "id_source",
        ["turn"],
        deduplicate=["id_source", "agent"],
        aggregate=["id_sample"],
        remainder_into="rest",
        part_rows=3,
    )
    return grouped.select(
        "id_source",
        "part",
        "agent",
        F.array_join("id_sample", ",").alias("ids"),
        F.array_join(F.col("rest.label").cast("array<string>"), ",").alias("rest"),
    )


@query(
    "AG-02",
    sql=f"""SELECT id_source, part, count(*) AS n, string_agg(agent || ':' || id_sample, ',' ORDER BY turn) AS samples
            FROM (SELECT *, (row_number() OVER (PARTITION BY id_source ORDER BY turn) - 1) // 1000 AS part
              FROM {SAMPLES}) GROUP BY id_source, part HAVING count(*) >= 2 OR part > 0""",
)
def paired_samples(spark, sf):
    paired = groups.paired_samples(samples(spark, sf), ["id_sample", "agent", "label", "text"])
    names = F.transform("samples", lambda s: F.concat_ws(":", s["agent"], s["id_sample"]))
    return paired.select(
        "id_source",
        "part",
        F.size("samples").cast("bigint").alias("n"),
        F.array_join(names, ",").alias("samples"),
    )


@query(
    "AG-03",
    sql=f"""SELECT id_source, agent, part, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS text
            FROM (SELECT *, (row_number() OVER (PARTITION BY id_source, agent ORDER BY turn) - 1) // 1000 AS part
              FROM {SAMPLES}) GROUP BY id_source, agent, part""",
)
def regroup_lines(spark, sf):
    lines = groups.regroup_lines(samples(spark, sf), ["id_source", "agent"], ["turn"], "text")
    return lines.select("id_source", "agent", "part", F.size("chunks").cast("bigint").alias("n"), "text")


@query(
    "AG-04",
    sql=f"""SELECT split, quality AS label, n, round(100 * n / sum(n) OVER (PARTITION BY split), 6) AS percent
            FROM (SELECT {SPLIT_SQL} AS split, quality, count(*) AS n FROM labels GROUP BY ALL)""",
)
def label_distribution(spark, sf):
    labels = table(spark, sf, "labels").select(hash_split().alias("split"), F.col("quality").alias("label"))
    return groups.label_distribution(labels, "split", "label").withColumn("percent", r6("percent"))


KEYS = ["split", "domain", "agent", "label"]


def measured(spark, sf):
    """Statistics of every document with its split, domain, agent and label."""
    docs = corpus(spark, sf, "lang", "source")
    narrow = with_text_metrics(docs).drop("text")
    labelled = narrow.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return labelled.select(
        hash_split().alias("split"),
        F.col("source").alias("domain"),
        F.col("lang").alias("agent"),
        F.col("quality").alias("label"),
        *METRICS,
    )


MEASURED = f"""(SELECT {SPLIT_SQL} AS split, source AS domain, lang AS agent, quality AS label,
  {', '.join(METRICS)} FROM ({metrics_sql('documents')}) LEFT JOIN labels USING (doc_id))"""
MOMENTS = ", ".join(
    f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in METRICS
)


def rounded_moments(df):
    moments = {f"{m}_{k}" for m in METRICS for k in ("mean", "std")}
    return df.select([r6(c).alias(c) if c in moments else c for c in df.columns])


@query(
    "AG-05",
    sql=f"WITH m AS (SELECT * FROM {MEASURED}) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std FROM m"
        for m in METRICS
    ),
)
def metrics_overall(spark, sf):
    return groups.metrics_overall(measured(spark, sf)).select(
        "metric", r6("mean").alias("mean"), r6("std").alias("std")
    )


@query("AG-06", sql=f"SELECT label, count(*) AS n, {MOMENTS} FROM {MEASURED} GROUP BY label")
def metrics_by_group(spark, sf):
    return rounded_moments(groups.metrics_by_group(measured(spark, sf), ["label"]))


@query(
    "AG-07",
    sql=f"""SELECT split, domain, agent, label, GROUPING(split, domain, agent, label)::BIGINT AS level,
              count(*) AS n, {MOMENTS} FROM {MEASURED}
            GROUP BY GROUPING SETS ((), (split), (domain), (agent), (label), (split, domain, agent, label))""",
)
def metrics_grouping_sets(spark, sf):
    return rounded_moments(groups.metrics_grouping_sets(measured(spark, sf), KEYS))


@query(
    "AG-08",
    sql="SELECT min(o_orderdate)::VARCHAR AS first, max(o_orderdate)::VARCHAR AS last FROM orders",
)
def date_range(spark, sf):
    """Dates arrive as strings; what does not parse is NULL and ignored."""
    raw = table(spark, sf, "orders").select(F.col("o_orderdate").cast("string").alias("date"))
    parsed = F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss"))
    return raw.agg(
        F.min(parsed).cast("string").alias("first"), F.max(parsed).cast("string").alias("last")
    )


@query("AG-09", sql=f"SELECT DISTINCT agent, label FROM {SAMPLES}")
def distinct_values(spark, sf):
    return samples(spark, sf).select("agent", "label").distinct()


LANGS = ["en", "de", "fr"]
#: Three columns by name, all other languages in the last.
CELLS = {c: f"lang = '{c}'" for c in LANGS} | {"other": "lang IS NULL OR lang NOT IN ('en', 'de', 'fr')"}


@query(
    "AG-24",
    sql=f"""SELECT source, {', '.join(f'round({c}, 6) AS {c}' for c in CELLS)},
              round(list_avg([{', '.join(CELLS)}]), 6) AS average
            FROM (SELECT source, {', '.join(f"avg(n_chars) FILTER ({hit}) AS {c}" for c, hit in CELLS.items())}
                  FROM documents GROUP BY source)""",
)
def cross_domain_matrix(spark, sf):
    docs = table(spark, sf, "documents")
    matrix = groups.cross_domain_matrix(docs, "source", "lang", LANGS, "n_chars")
    return matrix.select("source", *[r6(c).alias(c) for c in [*CELLS, "average"]])


@query(
    "AG-25",
    sql=f"""SELECT sum(n + 1)::BIGINT AS n_tokens, round(sum(n + 1) / 1000000 * 2.4::DOUBLE, 6) AS cost,
              sum(least(n, 2047) + 1)::BIGINT AS n_tokens_capped,
              round(sum(least(n, 2047) + 1) / 1000000 * 2.4::DOUBLE, 6) AS cost_capped
            FROM (SELECT len(list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda w: w <> '')) AS n
                  FROM documents)""",
)
def token_budget(spark, sf):
    budget = groups.token_budget(corpus(spark, sf), split_whitespace(F.col("text")), 2047, 2.4)
    return budget.withColumns({c: r6(c) for c in ("cost", "cost_capped")})


def span_rows(spark, sf):
    """Documents with a label per sentence: 1 for long ones, 2 for very long
    ones, and one label too few where the document ends without a full stop."""
    sentences = split_sentences(F.col("text"))
    docs = corpus(spark, sf).select("doc_id", "text", sentences.alias("spans"))
    label = F.transform(
        "spans", lambda s: F.when(F.length(s) > 400, 2).when(F.length(s) > 80, 1).otherwise(0)
    )
    even = F.col("text").rlike(r"[.!?]\s*\z")
    kept = F.when(even, label).otherwise(F.slice(label, 1, F.greatest(F.size(label) - 1, F.lit(1))))
    return docs.select("doc_id", hash_split().alias("split"), "spans", kept.alias("labels"))


SPANS = f"""(SELECT doc_id, split, spans, CASE WHEN even THEN l ELSE l[1:greatest(len(l) - 1, 1)] END AS labels FROM (
   SELECT doc_id, {SPLIT_SQL} AS split, spans, regexp_matches(text, '[.!?]\\s*$') AS even, list_transform(spans,
     lambda s: CASE WHEN length(s) > 400 THEN 2 WHEN length(s) > 80 THEN 1 ELSE 0 END) AS l
   FROM (SELECT doc_id, text, {SENTENCES_SQL} AS spans FROM documents)))"""


@query(
    "AG-26",
    sql=f"""SELECT split, count(*) AS n,
              count(*) FILTER (len(list_filter(labels, lambda x: x NOT IN (0, 1))) > 0) AS bad_label,
              count(*) FILTER (len(labels) <> len(spans)) AS bad_length FROM {SPANS} GROUP BY ROLLUP (split)""",
)
def label_sanity(spark, sf):
    return groups.label_sanity(span_rows(spark, sf), "split", "spans", "labels")


@query(
    "AG-27",
    sql=f"""WITH p AS (SELECT doc_id, len(list_filter(labels, lambda x: x > 0.5)) AS pos, len(labels) AS n FROM {SPANS}),
              t AS (SELECT greatest(count(*) FILTER (pos > 0), 1) AS sp, greatest(count(*) FILTER (pos = 0), 1) AS sn,
                greatest(sum(n - pos), 1)::DOUBLE / greatest(sum(pos), 1) AS pos_weight FROM p)
            SELECT doc_id, (pos > 0)::INT AS positive, round(1.0::DOUBLE / CASE WHEN pos > 0 THEN sp ELSE sn END, 6) AS weight,
              round(pos_weight, 6) AS pos_weight FROM p, t""",
)
def sampling_weights(spark, sf):
    weighted = groups.sampling_weights(span_rows(spark, sf), "labels")
    return weighted.select(
        "doc_id", "positive", r6("weight").alias("weight"), r6("pos_weight").alias("pos_weight")
    )


@query(
    "IO-13",
    sql="""SELECT source AS domain, count(*) AS total_collected, count(*) FILTER (lang <> 'en') AS total_synthesized,
             count(quality) AS total_feature_extracted FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def collection_manifest(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    joined = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy(F.col("source").alias("domain")).agg(
        F.count("*").alias("total_collected"),
        F.count_if(F.col("lang") != "en").alias("total_synthesized"),
        F.count("quality").alias("total_feature_extracted"),
    )
