"""Joins by id, text, position, constant tables and character ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.tokens import with_token_offsets
from textloom.operators import joins
from textloom.operators.evaluation import confusion_at
from textloom.operators.splits import matched_ids, matched_unmatched
from textloom.plans.registry import SAMPLES, SCORED, corpus, query, r6, samples, scored
from textloom.plans.text_queries import PIECES_SQL
from textloom.session import table

MATCHED = f"""(SELECT id_source FROM {SAMPLES} GROUP BY id_source
  HAVING bool_or(agent = 'human') AND bool_or(agent = 'assistant'))"""


@query("JN-01", sql=f"SELECT id_source FROM {MATCHED}")
def matched_id_list(spark, sf):
    return matched_ids(samples(spark, sf), ["assistant"]).select("id_source")


@query(
    "JN-02",
    sql=f"""SELECT id_sample, 'matched' AS part FROM {SAMPLES} SEMI JOIN {MATCHED} USING (id_source)
              WHERE agent IN ('human', 'assistant')
            UNION ALL SELECT id_sample, 'unmatched' FROM {SAMPLES} ANTI JOIN {MATCHED} USING (id_source)""",
)
def matched_unmatched_rows(spark, sf):
    matched, unmatched = matched_unmatched(samples(spark, sf), ["assistant"])
    return matched.select("id_sample", F.lit("matched").alias("part")).unionByName(
        unmatched.select("id_sample", F.lit("unmatched").alias("part"))
    )


@query(
    "JN-03",
    sql=f"""WITH s AS (SELECT * FROM {SAMPLES}), h AS (SELECT id_source, arg_min(text, turn) AS source_text
              FROM s WHERE agent = 'human' GROUP BY id_source)
            SELECT id_source, part, any_value(source_text) AS source_text, count(*) AS n,
              string_agg(agent || ':' || id_sample, ',' ORDER BY turn) AS rewrites
            FROM h JOIN (SELECT *, (row_number() OVER (PARTITION BY id_source ORDER BY turn) - 1) // 1000 AS part
              FROM s WHERE agent <> 'human') USING (id_source) GROUP BY id_source, part""",
)
def lookup_rewrites(spark, sf):
    turns = samples(spark, sf)
    human_first = turns.where("agent = 'human'").groupBy("id_source").agg(F.min("turn").alias("t0"))
    marked = turns.join(human_first, "id_source", "left").withColumn(
        "first", F.col("turn") == F.col("t0")
    )
    listed = joins.lookup_rewrites(marked)
    names = F.transform("rewrites", lambda r: F.concat_ws(":", r["agent"], r["id_sample"]))
    return listed.select(
        "id_source",
        "part",
        "source_text",
        F.size("rewrites").cast("bigint").alias("n"),
        F.array_join(names, ",").alias("rewrites"),
    )


@query(
    "JN-04",
    sql="""SELECT doc_id, source, n_chars FROM documents
           WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)""",
)
def documents_with_metrics(spark, sf):
    metrics = table(spark, sf, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return docs.join(metrics, "doc_id", "left_semi")


MERGE_CTES = """items AS (SELECT doc_id, text, [lang] AS agents FROM documents),
   results AS (SELECT text, min(id) AS result FROM (
     SELECT text, doc_id AS id FROM documents SEMI JOIN labels USING (doc_id)
     UNION ALL SELECT text || ' x', item_id FROM benchmark) GROUP BY text)"""


def _merge(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    items = docs.select("doc_id", "text", F.array("lang").alias("agents"))
    labelled = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi")
    results = labelled.select("text", F.col("doc_id").alias("result")).unionByName(
        table(spark, sf, "benchmark").select(
            F.concat("text", F.lit(" x")).alias("text"), F.col("item_id").alias("result")
        )
    )
    return joins.merge_by_text(items, results, agent="de")


@query(
    "JN-05",
    sql=f"""WITH {MERGE_CTES}
            SELECT doc_id, CASE WHEN r.text IS NOT NULL AND agents[1] <> 'de' THEN agents[1] || ',de'
              ELSE agents[1] END AS agents, CASE WHEN agents[1] <> 'de' THEN result END AS result
            FROM items i LEFT JOIN results r ON i.text = r.text""",
)
def merge_by_text(spark, sf):
    merged, _ = _merge(spark, sf)
    return merged.select("doc_id", F.array_join("agents", ",").alias("agents"), "result")


@query(
    "JN-05",
    sql=f"""WITH {MERGE_CTES} SELECT sha256(text) AS text_sha, result FROM results
            WHERE text NOT IN (SELECT text FROM items)""",
)
def merge_by_text_unmatched(spark, sf):
    return _merge(spark, sf)[1]


@query(
    "JN-06",
    sql="""SELECT position, doc_id, item_id, quality FROM
             (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM labels)
             JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id DESC) - 1 AS position FROM benchmark)
             USING (position)""",
)
def zip_join(spark, sf):
    left = table(spark, sf, "labels").select("doc_id", "quality")
    right = table(spark, sf, "benchmark").select("item_id")
    return joins.zip_join(left, right, ["doc_id"], [F.desc("item_id")])


@query(
    "JN-07",
    sql=f"""SELECT id_source, agent FROM (SELECT id_source, agent FROM
              (SELECT DISTINCT conv_id AS id_source FROM conversations),
              (SELECT unnest(['assistant', 'system', 'new-model']) AS agent))
            ANTI JOIN (SELECT id_source, agent FROM {SAMPLES}) USING (id_source, agent)""",
)
def pending_agent_work(spark, sf):
    turns = samples(spark, sf)
    items = turns.select("id_source").distinct()
    return joins.pending_agent_work(items, turns, ["assistant", "system", "new-model"])


@query(
    "JN-08",
    sql="""SELECT doc_id, CASE lang WHEN 'fr' THEN 'French' WHEN 'en' THEN 'English' END AS name,
           CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 END AS position FROM documents""",
)
def map_display_names(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    named = joins.map_display_names(docs, "lang", {"fr": "French", "en": "English"})
    return named.select("doc_id", "name", "position")


@query(
    "JN-09",
    sql=f"""SELECT model, lang AS dataset, count(*) AS n,
              round(avg(((y_score >= thr)::INT = y_true)::INT), 6) AS accuracy
            FROM {SCORED}, (SELECT unnest(['low', 'mid', 'high']) AS model, unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS thr)
            GROUP BY ALL""",
)
def cross_evaluate(spark, sf):
    """Every model on every data set in one pass over the scores."""
    models = {"low": 0.3, "mid": 0.5, "high": 0.7}
    cells = confusion_at(scored(spark, sf), ["lang"], models)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return cells.select(
        "model",
        F.col("lang").alias("dataset"),
        n.alias("n"),
        r6((F.col("tn") + F.col("tp")) / n).alias("accuracy"),
    )


@query(
    "JN-10",
    sql="""WITH t AS (SELECT vec_id, unnest(range(16))::INT AS i, embedding FROM embeddings),
           m AS (SELECT vec_id, i, list_transform(embedding[i*4+1:i*4+4], lambda x: x::DOUBLE) AS v FROM t)
           SELECT a.vec_id, a.i, b.i AS j, round(CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE
             list_cosine_similarity(a.v, b.v) END, 6) + 0 AS similarity FROM m a JOIN m b USING (vec_id)""",
)
def self_similarity(spark, sf):
    """Each vector read as a window of 16 tokens with 4 layer values."""
    matrix = F.transform(
        F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4)
    )
    windows = table(spark, sf, "embeddings").select("vec_id", matrix.alias("m"))
    pairs = joins.self_similarity(windows, "vec_id", "m")
    return pairs.withColumn("similarity", r6("similarity"))


@query(
    "JN-11",
    sql=f"""WITH r AS (SELECT doc_id, length(text) // 3 AS s, length(text) // 2 AS e FROM documents)
            SELECT doc_id, count(*) AS n_tokens,
              count(*) FILTER (start >= s AND start + length(piece) <= e) AS n_inside,
              count(*) FILTER (start < e AND start + length(piece) > s) AS n_touching
            FROM {PIECES_SQL} JOIN r USING (doc_id) WHERE is_token GROUP BY doc_id""",
)
def span_range_overlap(spark, sf):
    docs = corpus(spark, sf)
    n = F.length("text")
    ranges = docs.select(
        "doc_id",
        F.floor(n / 3).cast("int").alias("range_start"),
        F.floor(n / 2).cast("int").alias("range_end"),
    )
    related = joins.span_range_overlap(with_token_offsets(docs), ranges, "doc_id")
    return related.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"),
        F.count_if(F.col("relation") == "inside").alias("n_inside"),
        F.count_if(
            (F.col("start") < F.col("range_end")) & (F.col("end") > F.col("range_start"))
        ).alias("n_touching"),
    )
