"""Projections, filters, sorts, limits, set operations, user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from textloom.functions.text import collapse_whitespace, split_whitespace, strip
from textloom.operators import rows
from textloom.operators.processors import Processor, batched_map, run_detector
from textloom.operators.ranking import collect_parts, seeded_hash, with_rank
from textloom.operators.sampling import weighted_sample
from textloom.plans.registry import SAMPLES, corpus, query, r6, samples
from textloom.session import table

SPLIT_SQL = """CASE WHEN substr(md5(doc_id::VARCHAR), 1, 1) < 'c' THEN 'train'
  WHEN substr(md5(doc_id::VARCHAR), 1, 1) < 'e' THEN 'eval' ELSE 'test' END"""


def hash_split(key: str = "doc_id"):
    digit = F.substring(F.md5(F.col(key).cast("string")), 1, 1)
    return F.when(digit < "c", "train").when(digit < "e", "eval").otherwise("test")


# --- scans ------------------------------------------------------------------


@query(
    "IO-07",
    sql="""SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 200
           ORDER BY doc_id DESC LIMIT 50 OFFSET 10""",
)
def scan_filtered(spark, sf):
    docs = table(spark, sf, "documents").where("lang = 'en' AND n_chars > 200")
    return docs.select("doc_id", "source", "n_chars").orderBy(F.desc("doc_id")).offset(10).limit(50)


@query(
    "IO-08",
    sql="""SELECT count(*) AS n, least(count(*), 500) AS n_capped FROM documents
           WHERE lang = 'en' AND n_chars > 200""",
)
def count_matching(spark, sf):
    docs = table(spark, sf, "documents").where("lang = 'en' AND n_chars > 200")
    return docs.agg(F.count("*").alias("n"), F.least(F.count("*"), F.lit(500)).alias("n_capped"))


@query(
    "IO-09",
    sql="SELECT quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM labels",
)
def stringify_columns(spark, sf):
    labels = table(spark, sf, "labels").drop("doc_id")
    return labels.select([F.col(c).cast("string").alias(c) for c in labels.columns])


# --- projections ------------------------------------------------------------


@query("PF-01", sql="SELECT quality * 2 AS abc, doc_id, toxic FROM labels")
def map_rows(spark, sf):
    return table(spark, sf, "labels").select(
        (F.col("quality") * 2).alias("abc"), "doc_id", "toxic"
    )


@query(
    "PF-02",
    sql="""SELECT doc_id, 'quality' AS name, quality AS value FROM labels
           UNION ALL SELECT doc_id, 'toxic', toxic FROM labels""",
)
def flat_map_rows(spark, sf):
    return rows.flat_map_rows(
        table(spark, sf, "labels"),
        [F.col("doc_id"), F.lit("quality").alias("name"), F.col("quality").alias("value")],
        [F.col("doc_id"), F.lit("toxic").alias("name"), F.col("toxic").alias("value")],
    )


@query("PF-03", sql="SELECT doc_id, 1 - quality AS quality, toxic FROM labels")
def modify_rows(spark, sf):
    return table(spark, sf, "labels").withColumn("quality", 1 - F.col("quality"))


@query(
    "PF-04",
    sql="SELECT doc_id, upper(lang) AS lang, source || '-' || lang AS tag FROM documents",
)
def apply_column(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    tagged = rows.apply_column(docs, lambda s, l: F.concat_ws("-", s, l), "tag", "source", "lang")
    return rows.apply_column(tagged, F.upper, "lang").drop("source")


@query("PF-05", sql="SELECT * FROM labels WHERE quality = 1 AND toxic = 0")
def filter_rows(spark, sf):
    return table(spark, sf, "labels").where("quality = 1 AND toxic = 0")


@query("PF-06", sql="SELECT doc_id, lang, source FROM documents")
def remove_columns(spark, sf):
    return table(spark, sf, "documents").drop("text", "n_chars", "no_such_column")


@query("PF-07", sql="SELECT doc_id, quality FROM labels ORDER BY doc_id LIMIT 25 OFFSET 40")
def column_and_slice(spark, sf):
    return rows.slice_rows(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", 40, 65)


WS_SQL = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
STRIP_SQL = rf"regexp_replace(text, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


@query(
    "PF-08",
    sql=f"""SELECT doc_id, n_chars FROM documents
            WHERE length({STRIP_SQL}) > 100 AND length({STRIP_SQL}) < 125000""",
)
def filter_text_length(spark, sf):
    docs = corpus(spark, sf, "n_chars")
    return rows.filter_text_length(docs, min_length=100).select("doc_id", "n_chars")


@query("PF-09", sql="SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src3'")
def filter_by_equals(spark, sf):
    docs = table(spark, sf, "documents")
    return rows.filter_by_equals(docs, {"lang": "de", "source": "src3"}).select("doc_id")


@query(
    "PF-10",
    sql=f"""SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line
            FROM documents) WHERE regexp_replace(line, '{WS_SQL}', '', 'g') <> ''""",
)
def filter_nonempty_text(spark, sf):
    lines = table(spark, sf, "documents").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("line")
    )
    return lines.where(strip(F.col("line")) != "")


@query(
    "PF-11",
    sql="""SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
           WHERE quality IS NOT NULL AND toxic IS NOT NULL""",
)
def filter_required_fields(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.filter_required_fields(joined, ["quality", "toxic"]).select(
        "doc_id", "quality", "toxic"
    )


@query(
    "PF-12",
    sql="""SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.25)) AS n FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x > 0.25)) > 0""",
)
def filter_nonempty_features(spark, sf):
    features = table(spark, sf, "embeddings").select(
        "vec_id", F.filter("embedding", lambda x: x > 0.25).alias("features")
    )
    kept = features.where(F.size("features") > 0)
    return kept.select("vec_id", F.size("features").cast("bigint").alias("n"))


@query(
    "PF-13",
    sql="SELECT doc_id, quality + toxic AS label FROM labels WHERE quality + toxic IN (0, 1)",
)
def filter_binary_labels(spark, sf):
    tripled = table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") + F.col("toxic")).alias("label")
    )
    return tripled.where(F.col("label").isin(0, 1))


@query(
    "PF-14",
    sql="""SELECT doc_id, quality + toxic AS label FROM documents JOIN labels USING (doc_id)
           WHERE length(text) >= 150 AND quality + toxic IN (0, 1) AND lang NOT IN ('de', 'fr')""",
)
def filter_detectable(spark, sf):
    score = (
        F.when(F.col("lang") == "de", float("nan"))
        .when(F.col("lang") == "fr", float("inf"))
        .otherwise(F.col("n_chars").cast("double"))
    )
    joined = (
        table(spark, sf, "documents")
        .join(table(spark, sf, "labels"), "doc_id")
        .withColumns({"label": F.col("quality") + F.col("toxic"), "score": score})
    )
    return rows.filter_detectable(joined).select("doc_id", "label")


@query("PF-15", sql="SELECT doc_id, quality AS labels FROM labels")
def rename_label(spark, sf):
    return table(spark, sf, "labels").drop("toxic").withColumnRenamed("quality", "labels")


@query(
    "PF-16",
    sql="""SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS label,
           CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' END AS name
           FROM conversations""",
)
def encode_labels(spark, sf):
    names = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai")
    named = table(spark, sf, "conversations").select(
        "conv_id", "turn", rows.encode_label(F.coalesce(names, F.col("role"))).alias("label")
    )
    return named.withColumn("name", rows.decode_label(F.col("label")))


@query(
    "PF-17",
    sql=f"SELECT id_sample, CASE WHEN agent = 'human' THEN 0 ELSE 1 END AS label FROM {SAMPLES}",
)
def derive_binary_label(spark, sf):
    return samples(spark, sf).select(
        "id_sample", F.when(F.col("agent") == "human", 0).otherwise(1).alias("label")
    )


@query(
    "PF-18",
    sql="""SELECT conv_id, turn, CASE WHEN role = 'user' THEN conv_id || '-' || turn
           ELSE 'c' || conv_id END AS id_source FROM conversations""",
)
def derive_id_source(spark, sf):
    own, source = F.concat_ws("-", "conv_id", "turn"), F.concat(F.lit("c"), F.col("conv_id"))
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", own).otherwise(source).alias("id_source"),
    )


@query(
    "PF-19",
    sql="""SELECT event_id, replace(replace(event_type || '-v1:x', '-', '_'), ':', '_') AS agent,
           replace(event_type || '-v1:x', ':', '_') AS agent_export,
           replace(replace('org/' || event_type || ':x', '/', '--'), ':', '--') AS model
           FROM events""",
)
def normalize_agent_name(spark, sf):
    kind = F.col("event_type")
    tagged = F.concat(kind, F.lit("-v1:x"))
    return table(spark, sf, "events").select(
        "event_id",
        F.translate(tagged, "-:", "__").alias("agent"),
        F.translate(tagged, ":", "_").alias("agent_export"),
        F.regexp_replace(F.concat(F.lit("org/"), kind, F.lit(":x")), "[/:]", "--").alias("model"),
    )


def described(spark, sf):
    agent = F.when(F.col("lang") != "en", F.concat(F.lit("model-"), F.col("lang")))
    return rows.document_metadata(
        table(spark, sf, "documents"),
        id="doc_id",
        agent=agent,
        domain=F.col("source"),
        lang=F.col("lang"),
        source=F.lit(None).cast("string"),
    )


@query(
    "PF-20",
    sql="""SELECT doc_id::VARCHAR AS id, CASE WHEN lang <> 'en' THEN 'model-' || lang END AS agent,
           CASE WHEN lang <> 'en' THEN 'ai' ELSE 'human' END AS label, sha256(text) AS text_sha256,
           'source' AS type, source AS domain, lang, NULL::VARCHAR AS source FROM documents""",
)
def document_metadata(spark, sf):
    return described(spark, sf).select("document.*")


@query("PF-21", sql="SELECT doc_id, 'news' AS domain FROM documents")
def tag_domain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lit("news").alias("domain"))


@query(
    "PF-22",
    sql="""SELECT doc_id::VARCHAR AS id, sha256(text) AS text_sha256, 'ngram' AS model,
           nullif(len(list_filter(string_split(text, ' '), lambda w: length(w) > 20)), 0) AS n_features,
           source AS meta_source FROM documents""",
)
def feature_record(spark, sf):
    long_words = F.filter(F.split("text", " "), lambda w: F.length(w) > 20)
    record = rows.feature_record(
        described(spark, sf).withColumn("long_words", long_words),
        features=F.col("long_words"),
        metrics=F.array().cast("array<double>"),
        metadata=["source", "n_chars"],
        model="ngram",
    )
    return record.select(
        "document.id",
        "document.text_sha256",
        "model",
        F.size("features").cast("bigint").alias("n_features"),
        F.col("metadata.source").alias("meta_source"),
    )


@query(
    "PF-23",
    sql=f"""SELECT lang, {SPLIT_SQL} AS split, count(*) AS n FROM documents GROUP BY ALL""",
)
def split_by_value(spark, sf):
    """One keyed table instead of one table per value; empty ones do not appear."""
    docs = table(spark, sf, "documents").withColumn("split", hash_split())
    return docs.groupBy("lang", "split").agg(F.count("*").alias("n"))


def collected_items(spark, sf):
    """Items with nested AI counterparts, as a collector stores them."""
    turns = samples(spark, sf)
    human = turns.where("agent = 'human'").groupBy("id_source").agg(
        F.min_by("text", "turn").alias("text")
    )
    body = F.struct(F.col("text").alias("synth_text"))
    nested = collect_parts(
        turns.where("agent <> 'human'"),
        ["id_source"],
        ["turn"],
        {
            "synthetization": F.struct(
                "agent",
                F.when(F.col("agent") == "system", body).alias("synth_chunks"),
                F.when(F.col("agent") != "system", body).alias("synth_fulltext"),
            )
        },
    )
    return human.join(nested, "id_source")


@query(
    "PF-24",
    sql=f"""WITH s AS (SELECT * FROM {SAMPLES}), ai AS (SELECT DISTINCT id_source FROM s WHERE agent <> 'human')
      SELECT id_source, 'human' AS agent, 'source' AS type, arg_min(text, turn) AS text FROM s
      SEMI JOIN ai USING (id_source) WHERE agent = 'human' GROUP BY id_source
      UNION ALL SELECT id_source, agent, CASE WHEN agent = 'system' THEN 'chunk' ELSE 'fulltext' END, text
      FROM s WHERE agent <> 'human' AND id_source IN (SELECT id_source FROM s WHERE agent = 'human')""",
)
def explode_synthetization(spark, sf):
    return rows.explode_synthetization(collected_items(spark, sf))


@query("PF-25", sql=f"SELECT id_source, id_sample, agent, text FROM {SAMPLES}")
def flatten_samples(spark, sf):
    nested = collect_parts(
        samples(spark, sf),
        ["id_source"],
        ["turn"],
        {"samples": F.struct("id_sample", "agent", "text")},
    )
    return nested.select("id_source", F.inline("samples"))


@query(
    "PF-26",
    sql="""SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id)
           WHERE toxic IS NULL OR toxic = 1""",
)
def filter_in_or_null(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.filter_in_or_null(joined, "toxic", [None, 1]).select("doc_id", "toxic")


@query(
    "PF-27",
    sql=f"""WITH s AS (SELECT * FROM {SAMPLES})
      SELECT id_source, arg_min(agent, turn) AS agent,
        CASE WHEN arg_min(agent, turn) <> 'system' THEN arg_min(text, turn) END AS fulltext
      FROM s WHERE agent <> 'human' AND id_source IN (SELECT id_source FROM s WHERE agent = 'human')
      GROUP BY id_source""",
)
def project_nested_paths(spark, sf):
    first = F.element_at("synthetization", 1)
    return (
        collected_items(spark, sf)
        .where("part = 0")
        .select(
            "id_source",
            first["agent"].alias("agent"),
            first["synth_fulltext"]["synth_text"].alias("fulltext"),
        )
    )


@query(
    "PF-28",
    sql="""SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN source || '_' || lang
           ELSE source END AS config FROM documents""",
)
def config_name(spark, sf):
    name = rows.config_name(F.col("source"), F.col("lang"), ["src0", "src1"])
    return table(spark, sf, "documents").select("doc_id", name.alias("config"))


# --- sorts, limits, samples --------------------------------------------------


@query("ST-01", sql="SELECT doc_id, toxic FROM labels")
def sort_by(spark, sf):
    return rows.sort_by(table(spark, sf, "labels"), "quality", "doc_id", reverse=True, drop_key="quality")


@query(
    "ST-02",
    sql=f"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{WS_SQL}+'), lambda w: w <> '')) AS n
            FROM documents""",
)
def sort_by_length(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", split_whitespace(F.col("text")).alias("input_ids")
    )
    return rows.sort_by_length(docs).select("doc_id", F.size("input_ids").cast("bigint").alias("n"))


@query(
    "ST-03",
    sql="""SELECT source, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY source
           ORDER BY avg(n_chars) DESC, source LIMIT 5""",
)
def top_n_groups(spark, sf):
    means = table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean"))
    top = means.orderBy(F.desc("mean"), "source").limit(5)
    return top.select("source", r6("mean").alias("mean_chars"))


@query(
    "ST-04",
    sql="""SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS rank FROM labels""",
)
def seeded_shuffle(spark, sf):
    return with_rank(table(spark, sf, "labels").select("doc_id"), [seeded_hash(42, "doc_id")])


@query(
    "ST-05",
    sql="""SELECT lang, n, coalesce(list_position(['fr', 'en', 'de'], lang) - 1, 3)::INT AS position
           FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""",
)
def custom_order(spark, sf):
    counts = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return rows.custom_order(counts, "lang", ["fr", "en", "de"])


@query(
    "ST-06",
    sql="SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id) LIMIT 20",
)
def sample_n(spark, sf):
    return rows.sample_n(table(spark, sf, "documents").select("doc_id", "lang"), 20, 7, "doc_id")


@query(
    "ST-07",
    sql="""WITH w AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS before
             FROM documents SEMI JOIN labels USING (doc_id)),
           t AS (SELECT sum(n_chars)::DOUBLE AS total FROM w),
           d AS (SELECT range AS draw, ('0x' || substr(md5('11:' || range), 1, 12))::BIGINT::DOUBLE
             / 281474976710656.0::DOUBLE * (SELECT total FROM t) AS u
             FROM range((SELECT count(*) FROM documents)))
           SELECT draw, doc_id FROM d JOIN w ON u >= before AND u < before + n_chars""",
)
def weighted_sample_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    labelled = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi")
    drawn = weighted_sample(labelled, F.col("n_chars"), "doc_id", draws=docs.count(), seed=11)
    return drawn.select("draw", "doc_id")


@query(
    "ST-08",
    sql="""SELECT doc_id, source FROM documents
           QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) BETWEEN 4 AND 13""",
)
def limit_per_group(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return rows.limit_per_group(docs, ["source"], ["doc_id"], skip=3, take=10)


# --- set operations -----------------------------------------------------------


@query(
    "SO-01",
    sql=f"""SELECT {SPLIT_SQL} AS split, doc_id AS id, lang, n_chars FROM documents
            UNION ALL SELECT 'test', item_id, NULL, length(text) FROM benchmark""",
)
def concat_splits(spark, sf):
    docs = table(spark, sf, "documents").select(
        hash_split().alias("split"), F.col("doc_id").alias("id"), "lang", "n_chars"
    )
    extra = table(spark, sf, "benchmark").select(
        F.lit("test").alias("split"),
        F.col("item_id").alias("id"),
        F.length("text").cast("bigint").alias("n_chars"),
    )
    unmatched = docs.withColumn("split", F.lit("unmatched"))
    return rows.concat_splits([docs, extra, unmatched])


@query(
    "SO-02",
    sql="""SELECT conv_id FROM conversations WHERE role = 'user'
           INTERSECT SELECT conv_id FROM conversations WHERE role = 'system'""",
)
def intersect_ids(spark, sf):
    turns = table(spark, sf, "conversations")
    return (
        turns.where("role = 'user'").select("conv_id")
        .intersect(turns.where("role = 'system'").select("conv_id"))
    )


@query(
    "SO-03",
    sql="""SELECT conv_id, turn FROM conversations
           WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def except_ids(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    taken = turns.where("role = 'system'").select("conv_id").distinct()
    return turns.join(taken, "conv_id", "left_anti").select("conv_id", "turn")


@query(
    "SO-04",
    sql=f"SELECT id_sample, agent FROM {SAMPLES} WHERE agent IN ('human', 'system')",
)
def union_by_agent(spark, sf):
    return rows.select_agents(samples(spark, sf), "human+system+other").select("id_sample", "agent")


@query(
    "SO-05",
    sql="""SELECT quality AS label, 1 AS n_features, doc_id AS origin FROM labels
           UNION ALL SELECT label, len(embedding)::INT, vec_id FROM embeddings""",
)
def combine_corpora(spark, sf):
    left = table(spark, sf, "labels").select(
        F.col("quality").alias("label"),
        F.array(F.col("toxic").cast("float")).alias("features"),
        F.col("doc_id").alias("origin"),
    )
    right = table(spark, sf, "embeddings").select(
        "label", F.col("embedding").alias("features"), F.col("vec_id").alias("origin")
    )
    return left.unionAll(right).select("label", F.size("features").alias("n_features"), "origin")


@query(
    "SO-06",
    sql=f"""SELECT doc_id, CASE WHEN {SPLIT_SQL} = 'test' THEN 'test' ELSE 'train' END AS split
            FROM labels""",
)
def merge_train_eval(spark, sf):
    split = hash_split()
    return table(spark, sf, "labels").select(
        "doc_id",
        F.when(split.isin("train", "eval"), "train").otherwise(split).alias("split"),
    )


# --- user functions -----------------------------------------------------------


def count_words(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": batch["doc_id"], "n_words": batch["text"].str.split().str.len()})


@query(
    "UD-01",
    sql=f"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{WS_SQL}+'), lambda w: w <> ''))
            AS n_words FROM documents""",
)
def batched_map_words(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return batched_map(docs, count_words, "doc_id bigint, n_words bigint")


class VowelShare:
    """A stand-in detector: share of plain vowels, positive above a threshold."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def process(self, texts: pd.Series) -> pd.DataFrame:
        score = texts.str.count("[aeiou]") / texts.str.len()
        return pd.DataFrame({"y_score": score, "y_pred": (score >= self.threshold).astype("int32")})


@query(
    "UD-02",
    sql="""SELECT doc_id, round(length(regexp_replace(text, '[^aeiou]', '', 'g')) / length(text), 6) AS y_score,
           (length(regexp_replace(text, '[^aeiou]', '', 'g')) / length(text) >= 0.34)::INT AS y_pred
           FROM documents""",
)
def detector_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scores = run_detector(docs, VowelShare(0.34))
    return scores.select("doc_id", r6("y_score").alias("y_score"), "y_pred")


@query(
    "UD-03",
    sql=f"""SELECT doc_id, length(regexp_replace({STRIP_SQL}, '{WS_SQL}+', ' ', 'g')) AS n_kept FROM documents""",
)
def processor_pair(spark, sf):
    """Pre-processing adds a normalised text, post-processing measures and drops it."""
    tidy = Processor(
        pre=lambda df: df.withColumn("tidy", collapse_whitespace(F.col("text"))),
        post=lambda df: df.withColumn("n_kept", F.length("tidy").cast("bigint")),
        required=("text",),
        added=("tidy",),
    )
    docs = corpus(spark, sf)
    return tidy.post_process(tidy.pre_process(docs)).drop("text")


@query(
    "UD-04",
    sql="""SELECT CASE WHEN n_chars < 500 THEN 'short' ELSE 'long' END AS size, count(*) AS n
           FROM documents GROUP BY ALL""",
)
def group_by_expression(spark, sf):
    size = F.when(F.col("n_chars") < 500, "short").otherwise("long")
    return table(spark, sf, "documents").groupBy(size.alias("size")).agg(F.count("*").alias("n"))
