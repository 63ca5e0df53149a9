"""Token windows, chunk plans, sentence spans and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.patterns import SPACE, TOKEN
from textloom.functions.text import content_seed
from textloom.functions.tokens import token_list, with_token_offsets
from textloom.operators import spans as sp, windows as wn
from textloom.plans.registry import corpus, query, r6, spread_corpus
from textloom.plans.text_queries import PIECES_SQL, SENTENCES_SQL

TOKENS = f"(SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents)"


def tokenized(spark, sf):
    return corpus(spark, sf).select("doc_id", token_list(F.col("text")).alias("tokens"))


WINDOWS = f"""(SELECT doc_id, i::INT AS window_no, t[i*16+1 : i*16+64] AS ids, (i*16)::INT AS prefix_token_offset
   FROM (SELECT doc_id, t, unnest(range(greatest(ceil((len(t) - 64) / 16.0)::INT + 1, 1))) AS i FROM {TOKENS}))"""


@query(
    "WN-01",
    sql=f"""SELECT doc_id, window_no, prefix_token_offset, CASE WHEN window_no = 0 THEN 0 ELSE 48 END AS start_token_idx,
              (CASE WHEN window_no = 0 THEN len(ids) ELSE len(ids) - 48 END)::INT AS window_size,
              md5(array_to_string(ids, ' ')) AS ids_md5 FROM {WINDOWS}""",
)
def sliding_token_windows(spark, sf):
    cut = wn.sliding_token_windows(tokenized(spark, sf), "tokens", length=64, stride=16)
    return cut.withColumn("ids_md5", F.md5(F.array_join("input_ids", " "))).drop("input_ids")


LINES = f"""(SELECT doc_id, c, line, n, sum(n) OVER (PARTITION BY doc_id ORDER BY c)::INT AS after FROM (
   SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS c, unnest(l) AS line,
     len(regexp_extract_all(unnest(l), '{TOKEN}'))::INT AS n FROM (
     SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


@query(
    "WN-02",
    sql=f"""WITH l AS (SELECT * FROM {LINES}), s AS (
              SELECT b.doc_id, b.c, any_value(b.line) AS line, any_value(b.n) AS n, any_value(b.after) AS after,
                least(min(a.c) FILTER (b.after - (a.after - a.n) <= 60), b.c) AS s
              FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.c <= b.c GROUP BY b.doc_id, b.c)
            SELECT s.doc_id, s.s AS prefix_chunk_idx, s.c AS start_chunk_idx, s.c + 1 AS end_chunk_idx,
              s.after - s.n - (l.after - l.n) AS start_token_idx, least(s.after - (l.after - l.n), 60) AS length
            FROM s JOIN l ON l.doc_id = s.doc_id AND l.c = s.s
            WHERE regexp_replace(s.line, '[{SPACE}]+', '', 'g') <> ''""",
)
def rolling_prefix_windows(spark, sf):
    docs = corpus(spark, sf).select("doc_id", F.split("text", "\n").alias("chunks"))
    return wn.rolling_prefix_windows(docs, "doc_id", "chunks", length=60)


@query(
    "WN-03",
    sql=f"""SELECT doc_id, 'plain' AS kind, i::INT AS chunk_no, len(t[i*128+1 : i*128+128]) AS n, t[i*128+1] AS first
              FROM (SELECT doc_id, t, unnest(range(ceil(len(t) / 128.0)::INT)) AS i FROM {TOKENS})
            UNION ALL SELECT doc_id, 'detector', i::INT, len(t[i*64+1 : i*64+128]), t[i*64+1]
              FROM (SELECT doc_id, t, unnest(range(ceil(len(t) / 64.0)::INT)) AS i FROM {TOKENS})
              WHERE len(t[i*64+1 : i*64+128]) >= 10""",
)
def fixed_chunks(spark, sf):
    tokens = tokenized(spark, sf)

    def listed(kind: str, chunks):
        rows = tokens.select("doc_id", F.posexplode(chunks).alias("chunk_no", "c"))
        return rows.select(
            "doc_id",
            F.lit(kind).alias("kind"),
            "chunk_no",
            F.size("c").cast("bigint").alias("n"),
            F.get("c", F.lit(0)).alias("first"),
        )

    plain = wn.fixed_chunks(F.col("tokens"), 128)
    detector = wn.fixed_chunks(F.col("tokens"), 128, stride=64, min_tail=10)
    return listed("plain", plain).unionByName(listed("detector", detector))


@query(
    "WN-04",
    sql=f"SELECT doc_id, len(t[1:100]) AS n, array_to_string(t[1:100], ' ') AS text FROM {TOKENS}",
)
def truncate_tokens(spark, sf):
    cut = tokenized(spark, sf).withColumn("tokens", F.slice("tokens", 1, 100))
    return cut.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("text")
    )


# The feature length of a document is its number of tokens.
SENTENCE_SPANS = f"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS span_no, start, stop FROM (
   SELECT doc_id, i, start, least(start + n, total) AS stop, total FROM (
     SELECT doc_id, i, n, total, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS start FROM (
       SELECT doc_id, total, generate_subscripts(l, 1) AS i, len(regexp_extract_all(unnest(l), '{TOKEN}')) AS n
       FROM (SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS total, {SENTENCES_SQL} AS l FROM documents)))
   WHERE start < total))"""


def spans(docs):
    return wn.sentence_token_spans(docs, "doc_id")


@query(
    "WN-05",
    sql=f"""SELECT doc_id, span_no::INT AS span_no, start::INT AS start, stop::INT AS "end" FROM {SENTENCE_SPANS}""",
)
def sentence_token_spans(spark, sf):
    return spans(corpus(spark, sf))


@query(
    "WN-06",
    sql=f"""SELECT doc_id, span_no::INT AS span_no,
              coalesce(lag(start, 2) OVER (PARTITION BY doc_id ORDER BY span_no), start)::INT AS start,
              coalesce(lead(stop, 2) OVER (PARTITION BY doc_id ORDER BY span_no), stop)::INT AS "end"
            FROM {SENTENCE_SPANS}""",
)
def stack_neighbour_spans(spark, sf):
    return wn.stack_neighbour_spans(spans(corpus(spark, sf)), "doc_id", k=2)


@query("WN-07", sql=f"SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS text FROM {TOKENS}")
def reassemble_windows(spark, sf):
    """Cutting and putting together again gives the tokens back."""
    cut = wn.sliding_token_windows(tokenized(spark, sf), "tokens", length=64, stride=16)
    whole = wn.reassemble_windows(cut, "doc_id")
    return whole.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("text")
    )


def sql_pick(name: str, bound: str) -> str:
    return f"(('0x' || substr(md5('{name}:' || seed), 1, 12))::BIGINT % ({bound}))"


@query(
    "WN-14",
    sql=f"""WITH c AS (SELECT doc_id, string_split(text, chr(10)) AS l,
                ('0x' || right(sha256(text || source), 8))::BIGINT AS seed FROM documents),
              a AS (SELECT *, len(l) AS total, {sql_pick('amount', 'len(l) // 2')} + 1 AS k FROM c WHERE len(l) >= 4),
              b AS (SELECT *, {sql_pick('start', 'total - k + 1')} AS s FROM a)
            SELECT doc_id, seed, total::INT AS total_chunks, k::INT AS n_replaced, s::INT AS start_idx, (s + k)::INT AS end_idx,
              round(100.0::DOUBLE / total * k, 2) AS percent,
              array_to_string(list_filter(regexp_split_to_array(array_to_string(l[1:greatest(s - 1, 0)], ''),
                '[{SPACE}]+'), lambda w: w <> '')[-2000:], ' ') AS before,
              array_to_string(l[s + 1 : s + k], ' ') AS replaced,
              array_to_string(list_filter(regexp_split_to_array(array_to_string(l[s + k + 2 :], ''),
                '[{SPACE}]+'), lambda w: w <> '')[1:2000], ' ') AS after FROM b""",
)
def plan_chunk_replacement(spark, sf):
    docs = corpus(spark, sf, "source").select(
        "doc_id",
        F.split("text", "\n").alias("chunks"),
        content_seed(F.col("text"), F.col("source")).alias("seed"),
    )
    return wn.plan_chunk_replacement(docs, "chunks", F.col("seed")).drop("chunks")


# --- span labels ---------------------------------------------------------------

MIXED = """(SELECT doc_id, text, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS label,
   CASE WHEN lang = 'fr' THEN source || '__[' || n_chars // 3 || ':' || n_chars * 2 // 3 || ']'
     WHEN lang = 'es' AND source < 'src15' THEN source || '__[a:b]' ELSE source END AS source,
   n_chars // 3 AS lo, n_chars * 2 // 3 AS hi FROM documents)"""


def mixed(spark, sf):
    """Documents as human, AI and mixed samples with their offsets and spans."""
    n = F.col("n_chars")
    span = F.concat(
        "source",
        F.lit("__["),
        F.floor(n / 3).cast("string"),
        F.lit(":"),
        F.floor(n * 2 / 3).cast("string"),
        F.lit("]"),
    )
    broken = (F.col("lang") == "es") & (F.col("source") < "src15")
    # Both sides of the join are made of the same dealt rows, so that neither is dealt again.
    docs = spread_corpus(spark, sf, "lang", "source", "n_chars")
    labelled = docs.select(
        "doc_id",
        "text",
        F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2).alias("label"),
        F.when(F.col("lang") == "fr", span)
        .when(broken, F.concat("source", F.lit("__[a:b]")))
        .otherwise(F.col("source"))
        .alias("source"),
    )
    placed = labelled.join(sp.span_arrays(spans(docs), "doc_id"), "doc_id")
    # Offsets are found behind the join, which sorts the rows: they are several times larger than the text.
    return with_token_offsets(placed).drop("text")


TOKEN_OFFSETS = f"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k,
   start, start + length(piece) AS stop FROM {PIECES_SQL} WHERE is_token)"""


@query(
    "SC-16",
    sql=f"""SELECT s.doc_id, span_no::INT AS span_no, min(o.start)::INT AS start, max(o.stop)::INT AS "end"
            FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY span_no) - 1 AS span_no, start, stop
                  FROM {SENTENCE_SPANS} WHERE stop > start) s
            JOIN {TOKEN_OFFSETS} o ON o.doc_id = s.doc_id AND o.k >= s.start AND o.k < s.stop
            GROUP BY s.doc_id, span_no""",
)
def token_to_char_spans(spark, sf):
    placed = mixed(spark, sf)
    chars = sp.token_to_char_spans(F.col("spans"), F.col("offsets"))
    rows = placed.select("doc_id", F.posexplode(chars).alias("span_no", "c"))
    return rows.select("doc_id", "span_no", "c.start", "c.end")


SPAN_LABELS = f"""(SELECT doc_id, span_no, CASE WHEN label <> 2 THEN label
     WHEN NOT contains(source, '__') THEN 2 WHEN contains(source, 'a:b') THEN 0
     WHEN n_tokens = n_inside THEN 1 WHEN n_touching > 0 THEN 2 ELSE 0 END AS span_label
   FROM (SELECT s.doc_id, s.span_no, any_value(m.label) AS label, any_value(m.source) AS source, count(o.k) AS n_tokens,
       count(o.k) FILTER (o.start >= lo AND o.stop <= hi) AS n_inside,
       count(o.k) FILTER (o.start < hi AND o.stop > lo) AS n_touching
     FROM {SENTENCE_SPANS} s JOIN {MIXED} m ON m.doc_id = s.doc_id
     LEFT JOIN {TOKEN_OFFSETS} o ON o.doc_id = s.doc_id AND o.k >= s.start AND o.k < s.stop
     GROUP BY s.doc_id, s.span_no))"""


def labelled_spans(spark, sf):
    label = sp.span_labels(F.col("label"), F.col("source"), F.col("spans"), F.col("offsets"))
    return mixed(spark, sf).select("doc_id", "label", label.alias("span_labels"))


@query("SC-17", sql=f"SELECT doc_id, span_no::INT AS span_no, span_label FROM {SPAN_LABELS}")
def span_labels(spark, sf):
    # Not plain posexplode: for it the labels are worked out once more, before the join, to drop documents without any.
    rows = labelled_spans(spark, sf).select("doc_id", F.posexplode_outer("span_labels").alias("span_no", "span_label"))
    return rows.where("span_no IS NOT NULL")


@query(
    "SC-18",
    sql=f"""SELECT doc_id, span_no::INT AS span_no, CASE WHEN span_label = 2 THEN 1 ELSE span_label END AS span_label
            FROM {SPAN_LABELS}""",
)
def fold_fusion_label(spark, sf):
    folded = sp.fold_fusion_label(F.col("span_labels"))
    return labelled_spans(spark, sf).select(
        "doc_id", F.posexplode(folded).alias("span_no", "span_label")
    )


@query(
    "AG-29",
    sql=f"""SELECT doc_id, round(avg(1.0::DOUBLE / (1 + stop - start)) * 100, 6) AS avg, count(*) AS n,
              string_agg(start || '-' || stop, ',' ORDER BY span_no) AS spans
            FROM (SELECT doc_id, span_no, start::INT AS start, stop::INT AS stop FROM {SENTENCE_SPANS}) GROUP BY doc_id""",
)
def document_score(spark, sf):
    probability = 1.0 / (1 + F.col("end") - F.col("start"))
    scored = sp.document_score(spans(corpus(spark, sf)), "doc_id", probability)
    listed = F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return scored.select(
        "doc_id",
        r6("avg").alias("avg"),
        F.size("spans").cast("bigint").alias("n"),
        F.array_join(listed, ",").alias("spans"),
    )
