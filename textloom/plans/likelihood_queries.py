"""Count-based language model over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.patterns import TOKEN
from textloom.operators import backoff
from textloom.operators import likelihood as lm
from textloom.plans.registry import corpus, query, r6
from textloom.session import release

LM = f"""WITH RECURSIVE t AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS w
     FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS l FROM documents)),
   g AS (SELECT doc_id, pos, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS b,
     lag(w, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS a FROM t),
   m1 AS (SELECT w, c, c::DOUBLE / sum(c) OVER () AS p, row_number() OVER (ORDER BY c DESC, w) - 1 AS r
     FROM (SELECT w, count(*) AS c FROM t GROUP BY w)),
   m2 AS (SELECT b, w, c, sum(c) OVER (PARTITION BY b) AS cc, c::DOUBLE / sum(c) OVER (PARTITION BY b) AS p,
     row_number() OVER (PARTITION BY b ORDER BY c DESC, w) - 1 AS r
     FROM (SELECT b, w, count(*) AS c FROM g WHERE b IS NOT NULL GROUP BY b, w)),
   m3 AS (SELECT a, b, w, c, c::DOUBLE / sum(c) OVER (PARTITION BY a, b) AS p,
     row_number() OVER (PARTITION BY a, b ORDER BY c DESC, w) - 1 AS r
     FROM (SELECT a, b, w, count(*) AS c FROM g WHERE a IS NOT NULL GROUP BY a, b, w))"""


def sql_scores(order: int) -> str:
    """Both curvature scores of one order, per document."""
    model = f"m{order}"
    context = {1: [], 2: ["b"], 3: ["a", "b"]}[order]
    keys = [*context, "w"]
    moments = f"SELECT {''.join(c + ', ' for c in context)}sum(p * ln(p)) AS e, sum(p * ln(p) * ln(p)) - sum(p * ln(p)) * sum(p * ln(p)) AS v FROM {model}"
    if context:
        moments += f" GROUP BY {', '.join(context)}"
        attached = f"{model} JOIN ({moments}) USING ({', '.join(context)})"
    else:
        attached = f"{model}, ({moments})"
    return f"""SELECT doc_id, count(*) AS n,
        CASE WHEN sum(ln(1 + r)) > 0 THEN round(-sum(ln(p)) / sum(ln(1 + r)), 6) + 0.0::DOUBLE END AS llr,
        CASE WHEN sum(v) > 1e-9 THEN round((sum(ln(p)) - sum(e)) / sqrt(sum(v)), 6) + 0.0::DOUBLE END AS fast_detect
      FROM g JOIN (SELECT * FROM {attached}) USING ({', '.join(keys)}) WHERE pos >= 1 GROUP BY doc_id"""


def round_scores(df):
    return df.withColumns({c: r6(c) for c in ("llr", "fast_detect")})


@query(
    "LM-01",
    sql=f"""{LM} SELECT 1 AS n, w AS gram, c FROM m1 UNION ALL SELECT 2, b || ' ' || w, c FROM m2
            UNION ALL SELECT 3, a || ' ' || b || ' ' || w, c FROM m3""",
)
def ngram_counts(spark, sf):
    docs = corpus(spark, sf)
    whole = None
    for order in lm.ORDERS:
        counts = lm.ngram_counts(docs, order).select(
            F.lit(order).alias("n"), F.concat_ws(" ", *lm.gram_columns(order)).alias("gram"), "c"
        )
        whole = counts if whole is None else whole.unionByName(counts)
    return whole


@query(
    "LM-02",
    sql=f"""{LM} SELECT doc_id, count(*) AS n, round(sum(m1.p), 6) AS p1, round(sum(m2.p), 6) AS p2,
              round(sum(m3.p), 6) AS p3 FROM g JOIN m1 ON g.w = m1.w JOIN m2 ON g.b = m2.b AND g.w = m2.w
            LEFT JOIN m3 ON g.a = m3.a AND g.b = m3.b AND g.w = m3.w GROUP BY doc_id""",
)
def token_likelihoods(spark, sf):
    """The whole matrix is built; the result reports its shape and column sums."""
    matrix = lm.likelihood_matrix(lm.token_likelihoods(corpus(spark, sf)))
    layers = F.col("intermediate_likelihoods")

    def column_sum(i: int):
        present = F.filter(F.transform(layers, lambda row: row[i]), lambda p: p.isNotNull())
        total = F.aggregate(present, F.lit(0.0), lambda a, p: a + p)
        return F.when(F.size(present) > 0, r6(total))

    return matrix.select(
        "doc_id",
        F.size(layers).cast("bigint").alias("n"),
        *[column_sum(i).alias(f"p{i + 1}") for i in range(3)],
    )


@query("LM-03", sql=f"{LM} SELECT b AS w1, w AS w2, r AS rank FROM m2")
def target_ranks(spark, sf):
    model = lm.ngram_model(lm.train(corpus(spark, sf), 2), 2)
    return lm.with_target_ranks(model, 2).select("w1", "w2", "rank")


@query(
    "LM-04",
    sql=f"{LM} SELECT b AS w1, w AS w2, r AS rank, round(p, 6) AS p FROM m2 WHERE r <= 5",
)
def top_k_continuations(spark, sf):
    model = lm.ngram_model(lm.train(corpus(spark, sf), 2), 2)
    return lm.top_k_continuations(model, 2, k=5).select("w1", "w2", "rank", r6("p").alias("p"))


@query("LM-05", sql=f"{LM} SELECT doc_id, n, llr FROM ({sql_scores(2)})")
def llr_score(spark, sf):
    docs = corpus(spark, sf)
    return round_scores(lm.document_scores(docs, lm.fit_scoring(docs, 2))).drop("fast_detect")


@query("LM-06", sql=f"{LM} SELECT doc_id, n, fast_detect FROM ({sql_scores(2)})")
def fast_detect_score(spark, sf):
    docs = corpus(spark, sf)
    return round_scores(lm.document_scores(docs, lm.fit_scoring(docs, 2))).drop("llr")


@query(
    "LM-07",
    sql=f"{LM} "
    + " UNION ALL ".join(f"SELECT {o} AS layer, * FROM ({sql_scores(o)})" for o in (1, 2, 3)),
)
def scores_per_layer(spark, sf):
    docs = lm.tokenized(corpus(spark, sf))
    scored = lm.scores_per_layer(docs, lm.one_at_a_time(docs))
    release(docs)
    return round_scores(scored)


@query(
    "LM-08",
    sql=f"""{LM} SELECT doc_id, round(avg(-ln(p)), 6) + 0.0::DOUBLE AS mean_nll,
              round(median(-ln(p)), 6) + 0.0::DOUBLE AS median_nll
            FROM g JOIN m2 USING (b, w) GROUP BY doc_id""",
)
def perplexity(spark, sf):
    docs = corpus(spark, sf)
    return lm.perplexity(docs, lm.train(docs, 2)).select(
        "doc_id", r6("mean_nll").alias("mean_nll"), r6("median_nll").alias("median_nll")
    )


@query(
    "LM-09",
    sql=f"""{LM}, ce AS (SELECT b, sum(m2.p * -ln(m1.p)) AS ce FROM m2 JOIN m1 USING (w) GROUP BY b)
            SELECT doc_id, round(sum(-ln(m1.p)) / sum(ce), 6) AS ratio
            FROM g JOIN m1 USING (w) JOIN ce USING (b) GROUP BY doc_id""",
)
def cross_entropy_ratio(spark, sf):
    docs = corpus(spark, sf)
    return lm.cross_entropy_ratio(docs, lm.fit_ratio(docs)).withColumn("ratio", r6("ratio"))


@query(
    "LM-10",
    sql=f"""{LM}, n(token, depth, path, path_p, main, sibling, p) AS (
              SELECT w, 0, w, 1.0::DOUBLE, true, 0::BIGINT, 1.0::DOUBLE FROM m1 WHERE r < 3
              UNION ALL SELECT m2.w, depth + 1, path || ' ' || m2.w, path_p * m2.p, main AND m2.r = 0, m2.r, m2.p
              FROM n JOIN m2 ON m2.b = n.token AND m2.r < 4 WHERE depth < 4)
            SELECT token, depth, path, round(path_p, 6) AS path_p, main, sibling::INT AS sibling, round(p, 6) AS p
            FROM n WHERE depth > 0""",
)
def branch_paths(spark, sf):
    """Four levels of the four best continuations of the three commonest words."""
    docs = corpus(spark, sf)
    start = lm.top_k_continuations(lm.ngram_model(lm.train(docs, 1), 1), 1, k=2).select(F.col("w1").alias("token"))
    nodes = lm.branch_paths(lm.ngram_model(lm.train(docs, 2), 2), start, k=4, depth=4)
    return nodes.withColumns({c: r6(c) for c in ("path_p", "p")})


@query(
    "LM-11",
    sql=f"""{LM} SELECT w1, w2, round(p_t / sum(p_t) OVER (PARTITION BY w1), 6) AS p_t FROM (SELECT b AS w1, w AS w2, p_t,
              coalesce(sum(p_t) OVER (PARTITION BY b ORDER BY c DESC, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM (SELECT *, pow(p, 1 / 0.9::DOUBLE) / sum(pow(p, 1 / 0.9::DOUBLE)) OVER (PARTITION BY b) AS p_t FROM m2))
            WHERE before < 0.15::DOUBLE""",
)
def filter_continuations(spark, sf):
    """Temperature 0.9, then the continuations that make up the top 15 % of the tempered probabilities."""
    warmed = lm.apply_temperature(lm.ngram_model(lm.train(corpus(spark, sf), 2), 2), 2, temperature=0.9)
    return lm.filter_top_p(warmed, 2, p=0.15, share="p_t").select("w1", "w2", r6("p_t").alias("p_t"))


@query(
    "LM-12",
    sql=f"""{LM}, k AS (SELECT b, avg(p) AS top FROM m2 WHERE r <= 3 GROUP BY b)
            SELECT b AS w1, w AS w2, CASE WHEN r > 0 THEN round(-ln(p) / ln(1 + r), 6) + 0.0::DOUBLE END AS llr_token,
              round(top / p, 6) AS top_k_ratio, round(p / top, 6) AS inverse_ratio FROM m2 JOIN k USING (b)""",
)
def likelihood_ratio_features(spark, sf):
    features = lm.likelihood_ratio_features(lm.ngram_model(lm.train(corpus(spark, sf), 2), 2), 2, k=3)
    return features.select(
        "w1", "w2", *[r6(c).alias(c) for c in ("llr_token", "top_k_ratio", "inverse_ratio")]
    )


PROGRAMS = ["p2 v-div p1 s-max", "p2 v-sub p1 s-avg", "p3 v-> p2 s-avg", "p1 s-l2"]


@query(
    "LM-13",
    sql=f"""{LM}, v AS (SELECT doc_id, m1.p AS p1, m2.p AS p2, m3.p AS p3 FROM g JOIN m1 ON g.w = m1.w
                JOIN m2 ON g.b = m2.b AND g.w = m2.w LEFT JOIN m3 ON g.a = m3.a AND g.b = m3.b AND g.w = m3.w),
              f AS (SELECT doc_id, max(p2 / p1) AS f0, avg(p2 - p1) AS f1, avg((p3 > p2)::INT) AS f2,
                sqrt(sum(p1 * p1)) AS f3 FROM v GROUP BY doc_id)
            SELECT doc_id, {', '.join(f'round(coalesce((f{i} - avg(f{i}) OVER ()) / stddev_pop(f{i}) OVER (), 0), 6) + 0.0::DOUBLE AS f{i}' for i in range(4))}
            FROM f""",
)
def vector_feature_program(spark, sf):
    vectors = lm.token_likelihoods(corpus(spark, sf))
    features = lm.vector_features(vectors, "doc_id", PROGRAMS)
    return features.select("doc_id", *[r6(f"f{i}").alias(f"f{i}") for i in range(4)])


# --- back-off model on texts it was not fitted on ------------------------------------

def _discounts(table: str) -> str:
    """Discounts of the counts 1, 2 and more, per fold, from how many n-grams have the counts 1 to 4."""

    def of(k: int) -> str:
        share = f"{k} - {k + 1} * (n1 / (n1 + 2.0::DOUBLE * n2)) * n{k + 1} / n{k}"
        return f"CASE WHEN n{k} > 0 AND n1 > 0 THEN least(greatest({share}, 0.0::DOUBLE), {k}.0::DOUBLE) ELSE 0.0::DOUBLE END AS d{k}"

    counts = ", ".join(f"(count(*) FILTER (c = {i}))::DOUBLE AS n{i}" for i in (1, 2, 3, 4))
    return f"SELECT f, {of(1)}, {of(2)}, {of(3)} FROM (SELECT f, {counts} FROM {table} GROUP BY f)"


_LESS = "CASE {c} WHEN 1 THEN {d}.d1 WHEN 2 THEN {d}.d2 ELSE {d}.d3 END"


def _contexts(table: str, context: str) -> str:
    kinds = "any_value(d1) * count(*) FILTER (c = 1) + any_value(d2) * count(*) FILTER (c = 2) + any_value(d3) * count(*) FILTER (c > 2)"
    return f"SELECT f{context}, sum(c)::DOUBLE AS total, ({kinds}) / sum(c)::DOUBLE AS gamma, count(*) AS known FROM {table} JOIN d{table[1]} USING (f) GROUP BY f{context}"


def _own(order: int) -> str:
    c, d = f"c{order}.c", f"d{order}"
    return f"coalesce(({c} - {_LESS.format(c=c, d=d)}) / x{order}.total, 0.0::DOUBLE)"


BACKOFF = f"""WITH l AS (SELECT doc_id, (substr(md5(doc_id::VARCHAR), 1, 1) < '8')::INT AS fold,
     regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents),
   g AS (SELECT doc_id, fold, i, CASE WHEN i > 2 THEN t[i - 2] ELSE '' END AS a, CASE WHEN i > 1 THEN t[i - 1] ELSE '' END AS b,
     t[i] AS w FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM l)),
   c3 AS (SELECT 1 - fold AS f, a, b, w, count(*) AS c FROM g GROUP BY ALL),
   c2 AS (SELECT f, b, w, count(*) AS c FROM c3 GROUP BY ALL), c1 AS (SELECT f, w, count(*) AS c FROM c2 GROUP BY ALL),
   d3 AS ({_discounts('c3')}), d2 AS ({_discounts('c2')}), d1 AS ({_discounts('c1')}),
   x3 AS ({_contexts('c3', ', a, b')}), x2 AS ({_contexts('c2', ', b')}), x1 AS ({_contexts('c1', '')}),
   p AS (SELECT doc_id, {_own(1)} + x1.gamma / (x1.known + 1) AS p1, {_own(2)} AS o2, coalesce(x2.gamma, 1.0::DOUBLE) AS g2,
       {_own(3)} AS o3, coalesce(x3.gamma, 1.0::DOUBLE) AS g3
     FROM g JOIN d1 ON d1.f = fold JOIN d2 ON d2.f = fold JOIN d3 ON d3.f = fold JOIN x1 ON x1.f = fold
       LEFT JOIN c1 ON c1.f = fold AND c1.w = g.w LEFT JOIN c2 ON c2.f = fold AND c2.b = g.b AND c2.w = g.w
       LEFT JOIN c3 ON c3.f = fold AND c3.a = g.a AND c3.b = g.b AND c3.w = g.w
       LEFT JOIN x2 ON x2.f = fold AND x2.b = g.b LEFT JOIN x3 ON x3.f = fold AND x3.a = g.a AND x3.b = g.b)"""


@query(
    "LM-02",
    "LM-08",
    sql=f"""{BACKOFF} SELECT doc_id, count(*) AS n, round(avg(-ln(p1)), 6) + 0.0::DOUBLE AS nll_1,
              round(avg(-ln(o2 + g2 * p1)), 6) + 0.0::DOUBLE AS nll_2, round(avg(-ln(o3 + g3 * (o2 + g2 * p1))), 6) + 0.0::DOUBLE AS nll_3,
              round(median(-ln(o3 + g3 * (o2 + g2 * p1))), 6) + 0.0::DOUBLE AS median_nll FROM p GROUP BY doc_id""",
)
def held_out_perplexity(spark, sf):
    """Every document under the back-off model of the other half of the documents."""
    fold = (F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) < "8").cast("int")
    scored = backoff.cross_fitted(corpus(spark, sf), fold, (0, 1))
    found = backoff.document_nll(scored, lm.ORDERS)
    return found.select("doc_id", "n", *[r6(c).alias(c) for c in found.columns[2:]])
