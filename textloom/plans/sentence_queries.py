"""Sentence boundaries learned from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.patterns import SPACE
from textloom.operators import sentences as st
from textloom.plans.registry import corpus, query, r6
from textloom.plans.text_queries import sql_strip


def _type(token: str) -> str:
    return f"lower(regexp_replace(regexp_replace({token}, '^[{st.OPENERS}]+', ''), '[.!?,;:{st.CLOSERS}]+$', ''))"


def _form(token: str) -> str:
    return rf"""CASE WHEN regexp_matches({token}, '\.\.[{st.CLOSERS}]*$') THEN 'dots' WHEN regexp_matches({token}, '\.[{st.CLOSERS}]*$') THEN 'dot'
      WHEN regexp_matches({token}, '{st.ENDS}') THEN 'end' ELSE 'none' END"""


def _case(token: str) -> str:
    return rf"""CASE WHEN regexp_matches({token}, '^[{st.OPENERS}]*\p{{Lu}}') THEN 'upper'
      WHEN regexp_matches({token}, '^[{st.OPENERS}]*\p{{Ll}}') THEN 'lower' ELSE 'none' END"""


def _tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{SPACE}]+'), lambda t: t <> '')"


def _times_ln(x: str, p: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * ln({p}) ELSE 0.0::DOUBLE END"


def _ratio(both: str, first: str, second: str, total: str) -> str:
    apart, rest = f"({second} - {both})", f"greatest({total} - {first} - {second} + {both}, 0)"
    p, p1, p2 = f"({second} / {total})", f"({both} / {first})", f"({apart} / ({total} - {first}))"

    def binomial(k: str, rest: str, share: str) -> str:
        return f"({_times_ln(k, share)} + {_times_ln(rest, f'(1 - {share})')})"

    less = f"({first} - {both})"
    return f"2.0::DOUBLE * ({binomial(both, less, p1)} + {binomial(apart, rest, p2)} - {binomial(both, less, p)} - {binomial(apart, rest, p)})"


BOUNDARIES = rf"""WITH listed AS (SELECT doc_id, text, {_tokens('text')} AS l FROM documents),
  tok AS (SELECT t, begins, count(*) AS c FROM (SELECT l[i] AS t, i = 1 OR regexp_matches(l[i - 1], '{st.ENDS}') AS begins
    FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM listed)) GROUP BY ALL),
  types AS (SELECT type, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (form = 'dot'), 0)::BIGINT AS dotted, coalesce(sum(c) FILTER (cs = 'lower'), 0) AS lo,
      coalesce(sum(c) FILTER (cs = 'upper' AND NOT begins), 0) AS inside, coalesce(sum(c) FILTER (cs = 'upper'), 0) AS up
    FROM (SELECT {_type('t')} AS type, {_form('t')} AS form, {_case('t')} AS cs, begins, c FROM tok) GROUP BY type),
  whole AS (SELECT sum(n)::DOUBLE AS total, (sum(dotted) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS share FROM types),
  scores AS (SELECT type, n, dotted, 2.0::DOUBLE * (dotted * (ln(0.99::DOUBLE) - ln(share)) + (n - dotted) * (ln(1 - 0.99::DOUBLE) - ln(1 - share)))
      * exp(-bare) * (length(type) - bare + 1) * pow(bare::DOUBLE, -(n - dotted)::DOUBLE) AS score
    FROM (SELECT *, length(replace(type, '.', '')) AS bare FROM types), whole WHERE dotted > 0 AND regexp_matches(type, '\p{{L}}')),
  cut AS (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS pos FROM
    (SELECT doc_id, string_split(regexp_replace(text, '{st.POSSIBLE_END}', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents)),
  worded AS (SELECT doc_id, pos, piece, {_tokens('piece')} AS l FROM cut),
  ends AS (SELECT doc_id, pos, x, y, {_type('x')} AS t1, {_type('y')} AS t2, {_form('x')} AS form, {_case('y')} AS cs
    FROM (SELECT doc_id, pos, l[-1] AS x, lead(l[1]) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM worded) WHERE x IS NOT NULL AND y IS NOT NULL),
  kinds AS (SELECT ends.*, coalesce(score >= {st.ABBREVIATION}, false) AS short, regexp_matches(t1, '^\p{{L}}$') AS single,
    regexp_matches(t1, '^\p{{Nd}}+$') AS number FROM ends LEFT JOIN scores ON type = t1),
  behind AS (SELECT t2, count(*) AS b, sum(count(*)) OVER ()::DOUBLE AS breaks FROM kinds
    WHERE form = 'end' OR (form = 'dot' AND NOT short AND NOT single AND NOT number) GROUP BY t2),
  starters AS (SELECT t2 FROM behind JOIN types ON type = t2, whole WHERE b / breaks > n / total AND {_ratio('b', 'breaks', 'n', 'total')} >= {st.STARTER}),
  held AS (SELECT t1, t2 FROM (SELECT t1, t2, count(*) AS b FROM kinds WHERE form = 'dot' AND (single OR number) GROUP BY t1, t2)
    JOIN types x ON x.type = t1 JOIN types y ON y.type = t2, whole
    WHERE b / x.dotted > y.n / total AND {_ratio('b', 'x.dotted', 'y.n', 'total')} >= {st.COLLOCATION}),
  judged AS (SELECT kinds.*, cs = 'upper' AND lo > 0 AND inside = 0 AS begins, cs = 'lower' AND up > 0 AS goes_on, lo, s.t2 IS NOT NULL AS starts,
    h.t2 IS NOT NULL AS held FROM kinds JOIN types ON type = kinds.t2 LEFT JOIN starters s ON s.t2 = kinds.t2
    LEFT JOIN held h ON h.t1 = kinds.t1 AND h.t2 = kinds.t2),
  decided AS (SELECT doc_id, pos, x, y, CASE WHEN form = 'end' THEN true
    WHEN short OR form = 'dots' THEN begins OR (cs = 'upper' AND starts) WHEN held AND NOT starts THEN false
    WHEN (single OR number) AND goes_on THEN false WHEN single AND cs = 'upper' AND lo = 0 AND NOT begins AND NOT starts THEN false
    ELSE true END AS is_end FROM judged)"""


@query(
    "SC-09",
    sql=f"""{BOUNDARIES} SELECT type, n, dotted, round(score, 6) + 0.0::DOUBLE AS score, score >= {st.ABBREVIATION} AS abbreviation FROM scores""",
)
def abbreviation_scores(spark, sf):
    """Every word that stands before a period, with its score as an abbreviation."""
    scores = st.learn_boundaries(corpus(spark, sf)).abbreviations
    return scores.select("type", "n", "dotted", r6("score").alias("score"), (F.col("score") >= st.ABBREVIATION).alias("abbreviation"))


@query(
    "SC-09",
    sql=f"""{BOUNDARIES}, numbered AS (SELECT cut.doc_id, cut.pos, piece, coalesce(sum(CASE WHEN coalesce(is_end, true) THEN 1 ELSE 0 END)
              OVER (PARTITION BY cut.doc_id ORDER BY cut.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
            FROM cut LEFT JOIN decided USING (doc_id, pos)),
          joined AS (SELECT doc_id, k, {sql_strip("string_agg(piece, '' ORDER BY pos)")} AS sentence FROM numbered GROUP BY doc_id, k)
          SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sent_no, sentence FROM joined WHERE sentence <> ''""",
)
def learned_sentences(spark, sf):
    """Sentences of every document by what the documents themselves say about abbreviations and names."""
    docs = corpus(spark, sf)
    found = st.with_sentences(docs, st.learn_boundaries(docs))
    rows = found.select("doc_id", F.posexplode("sentences").alias("sent_no", "sentence"))
    return rows.withColumn("sent_no", F.col("sent_no").cast("bigint"))
