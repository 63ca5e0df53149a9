"""Cleaning, chunking, tokens and per-document statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.patterns import (
    ASCII_PUNCT,
    CLOSED_SENTENCE,
    DIGIT,
    SENTENCE_RUN,
    SPACE,
    TOKEN,
    UPPER,
    URL,
    WORD,
)
from textloom.functions.statistics import METRICS, with_text_metrics, words
from textloom.functions.tokens import encode_tokens, offset_table, token_table, vocabulary
from textloom.plans.registry import corpus, query, r6, spread_corpus
from textloom.session import spread_small, table


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_words(expr: str, ascii_rules: bool = False) -> str:
    inner = ASCII_PUNCT if ascii_rules else f"^{WORD}"
    keep = "[A-Za-z0-9]" if ascii_rules else r"[\p{L}\p{N}]"
    return f"""list_filter(list_transform(regexp_split_to_array({expr}, '[{SPACE}]+'),
      lambda w: regexp_replace(w, '^[{inner}]+|[{inner}]+$', '', 'g')),
      lambda w: regexp_matches(w, '{keep}'))"""


def metrics_sql(source: str, ascii_rules: bool = False) -> str:
    """The twelve statistics in SQL, written independently of the Spark columns."""
    punct = rf"[^\p{{L}}\p{{N}}{SPACE}]" if ascii_rules else f"[^{WORD}{SPACE}]"
    empty = f"regexp_replace(text, '[{SPACE}]+', '', 'g') = ''" if ascii_rules else "text = ''"
    return f"""SELECT * EXCLUDE (text, w, l, n_upper, n_digit),
      CASE WHEN n_words = 0 THEN 0 ELSE length(array_to_string(w, ''))::DOUBLE / n_words END AS avg_word_len,
      CASE WHEN n_chars_nospace = 0 THEN 0 ELSE n_punct::DOUBLE / n_chars_nospace END AS punct_ratio,
      CASE WHEN n_chars_nospace = 0 THEN 0 ELSE n_upper::DOUBLE / n_chars_nospace END AS upper_ratio,
      CASE WHEN n_chars_nospace = 0 THEN 0 ELSE n_digit::DOUBLE / n_chars_nospace END AS digit_ratio,
      CASE WHEN n_words = 0 THEN 0 ELSE len(list_distinct(l))::DOUBLE / n_words END AS type_token_ratio,
      CASE WHEN n_words = 0 THEN 0 ELSE
        len(list_filter(map_values(list_histogram(l)), lambda c: c = 1))::DOUBLE / n_words END AS hapax_ratio
    FROM (SELECT *, len(w) AS n_words, list_transform(w, lambda x: lower(x)) AS l FROM (
      SELECT * EXCLUDE (n_chars), length(text) AS n_chars, {sql_words('text', ascii_rules)} AS w,
        length(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS n_chars_nospace,
        CASE WHEN {empty} THEN 0
          ELSE greatest(1, len(regexp_extract_all(text, '{SENTENCE_RUN}'))) END AS n_sents,
        len(regexp_extract_all(text, '{punct}')) AS n_punct,
        len(regexp_extract_all(text, '[{UPPER}]')) AS n_upper,
        len(regexp_extract_all(text, '[{DIGIT}]')) AS n_digit,
        len(regexp_extract_all(text, '{URL}')) AS url_count
      FROM {source}))"""


def _per_document(ascii_rules: bool) -> str:
    counts = [m for m in METRICS if m.startswith("n_") or m == "url_count"]
    ratios = [m for m in METRICS if m not in counts]
    columns = [f"{m}::BIGINT AS {m}" for m in counts] + [f"round({m}, 6) AS {m}" for m in ratios]
    return f"SELECT doc_id, {', '.join(columns)} FROM ({metrics_sql('documents', ascii_rules)})"


def _rounded(df):
    return df.select(
        "doc_id",
        *[m if m.startswith("n_") or m == "url_count" else r6(m).alias(m) for m in METRICS],
    )


@query("SC-12", sql=_per_document(False))
def text_metrics(spark, sf):
    return _rounded(with_text_metrics(corpus(spark, sf)))


@query("SC-13", sql=_per_document(True))
def text_metrics_ascii(spark, sf):
    return _rounded(with_text_metrics(corpus(spark, sf), ascii_rules=True))


@query(
    "SC-01",
    sql=f"""SELECT doc_id, {sql_strip(f"regexp_replace(nfc_normalize(text), '[{SPACE}]+', ' ', 'g')")} AS text
            FROM documents""",
)
def normalize_text(spark, sf):
    return corpus(spark, sf).select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


@query("SC-02")
def clean_unicode(spark, sf):
    return corpus(spark, sf).select("doc_id", tx.clean_unicode(F.col("text")).alias("text"))


def _markup_sql(key: str, column: str, source: str) -> str:
    flat = f"regexp_replace({column}, chr(10), ' ', 'g')"
    placeholder = tx.PLACEHOLDER.replace("'", "''")
    cleaned = f"regexp_replace(regexp_replace({flat}, '{placeholder}', '', 'g'), '{tx.MARKUP}', '', 'g')"
    return f"""SELECT {key} AS id, '{source}' AS origin,
      {sql_strip(f"regexp_replace({cleaned}, '[{SPACE}]{{2,}}', ' ', 'g')")} AS text FROM {source}"""


@query(
    "SC-03",
    sql=f"""{_markup_sql('doc_id', 'text', 'documents')} UNION ALL {_markup_sql('page_id', 'html', 'pages')}""",
)
def strip_markup_artifacts(spark, sf):
    texts = corpus(spark, sf).select(
        F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), "text"
    )
    pages = spread_small(table(spark, sf, "pages"), "page_id").select(
        F.col("page_id").alias("id"), F.lit("pages").alias("origin"), F.col("html").alias("text")
    )
    return texts.unionByName(pages).withColumn("text", tx.strip_markup_artifacts(F.col("text")))


@query(
    "SC-04",
    sql=f"""SELECT doc_id, {sql_strip(f"regexp_replace(text, '[{SPACE}]+', ' ', 'g')")} AS text
            FROM documents""",
)
def collapse_whitespace(spark, sf):
    return corpus(spark, sf).select("doc_id", tx.collapse_whitespace(F.col("text")).alias("text"))


@query(
    "SC-05",
    sql="""SELECT doc_id, body AS text, body <> text AS truncated FROM (SELECT doc_id, text,
             CASE WHEN regexp_matches(text, '[.!?]')
             THEN array_to_string(regexp_extract_all(text, '[^.!?]*[.!?]'), '') ELSE text END AS body
             FROM documents)""",
)
def truncate_to_sentence(spark, sf):
    cut = corpus(spark, sf).withColumn("body", tx.truncate_to_sentence(F.col("text")))
    return cut.select(
        "doc_id", F.col("body").alias("text"), (F.col("body") != F.col("text")).alias("truncated")
    )


@query(
    "SC-06",
    sql=f"""SELECT conv_id, turn, {sql_strip("regexp_replace(t, '<think>.*?</think>', '', 'gs')")} AS text
            FROM (SELECT conv_id, turn, '<think>' || role || chr(10) || 'x</think> ' || text || '<think>y</think>' AS t
                  FROM conversations)""",
)
def strip_reasoning(spark, sf):
    reply = F.concat(
        F.lit("<think>"), "role", F.lit("\nx</think> "), "text", F.lit("<think>y</think>")
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.strip_reasoning(reply).alias("text")
    )


@query(
    "SC-07",
    sql=f"""SELECT doc_id, (pos - 1) // 4 AS chunk_no, string_agg(s, ' ' ORDER BY pos) AS chunk FROM (
             SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM (
               SELECT doc_id, regexp_extract_all(text, '{CLOSED_SENTENCE}') AS l FROM documents))
           GROUP BY ALL""",
)
def sentence_chunks(spark, sf):
    split = corpus(spark, sf).select("doc_id", tx.closed_sentences(F.col("text")).alias("s"))
    chunks = split.select(
        "doc_id", F.posexplode(tx.group_sentences(F.col("s"))).alias("chunk_no", "chunk")
    )
    return chunks.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


@query(
    "SC-08",
    sql="""SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
)
def line_chunks(spark, sf):
    lines = corpus(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))


SENTENCES_SQL = f"""list_filter(list_transform(string_split(
  regexp_replace(text, '([.!?]+)[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)),
  lambda s: {sql_strip('s')}), lambda s: s <> '')"""


@query(
    "SC-09",
    sql=f"""SELECT doc_id, generate_subscripts(l, 1) - 1 AS sent_no, unnest(l) AS sentence
            FROM (SELECT doc_id, {SENTENCES_SQL} AS l FROM documents)""",
)
def split_sentences(spark, sf):
    sentences = corpus(spark, sf).select(
        "doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("sent_no", "sentence")
    )
    return sentences.withColumn("sent_no", F.col("sent_no").cast("bigint"))


@query(
    "SC-10",
    sql=f"""SELECT conv_id, turn, array_to_string(list_transform(string_split(text, '.'),
            lambda c: {sql_strip('c')}), ' ') AS text FROM conversations""",
)
def join_chunks(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.join_chunks(F.split("text", r"\.")).alias("text")
    )


@query(
    "SC-11",
    sql="""SELECT doc_id, ('0x' || right(sha256(text || source || lang), 8))::BIGINT AS seed,
           sha256(text) AS text_sha256,
           sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS config_sha256
           FROM documents""",
)
def content_seed(spark, sf):
    config = F.to_json(F.struct("lang", "source"))
    return corpus(spark, sf, "source", "lang").select(
        "doc_id",
        tx.content_seed(F.col("text"), F.col("source"), F.col("lang")).alias("seed"),
        F.sha2("text", 256).alias("text_sha256"),
        F.sha2(config, 256).alias("config_sha256"),
    )


@query(
    "SC-14",
    sql=f"""SELECT doc_id, word, count(*) AS n FROM (
             SELECT doc_id, lower(unnest({sql_words('text')})) AS word FROM documents) GROUP BY ALL""",
)
def word_table(spark, sf):
    """Word counts per document: the long form behind type and hapax counts."""
    exploded = spread_corpus(spark, sf).select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    return exploded.groupBy("doc_id", F.lower("word").alias("word")).agg(F.count("*").alias("n"))


PIECES_SQL = f"""(SELECT doc_id, pos, piece, regexp_matches(piece, '{TOKEN}') AS is_token,
   sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) - length(piece) AS start
   FROM (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS pos FROM (
     SELECT doc_id, regexp_extract_all(text, '{TOKEN}|[^{TOKEN[1:-2]}]+') AS l FROM documents)))"""


@query(
    "SC-15",
    sql=f"""WITH t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos,
              start, start + length(piece) AS "end", lower(piece) AS token FROM {PIECES_SQL} WHERE is_token),
            v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS token_id
              FROM t GROUP BY token)
            SELECT doc_id, pos::INT AS pos, start::INT AS start, "end"::INT AS "end", token, token_id
            FROM t JOIN v USING (token)""",
)
def tokenize_with_offsets(spark, sf):
    docs = corpus(spark, sf)
    placed = offset_table(docs).withColumn("token", F.lower("token"))
    return encode_tokens(placed, vocabulary(token_table(docs)))


TEMPLATE = "Write [LENGTH] words for [DOMAIN] dated [DATE]; again: [LENGTH]."


@query(
    "SC-26",
    sql=f"""SELECT doc_id, replace(replace(replace('{TEMPLATE}', '[LENGTH]', n::VARCHAR), '[DOMAIN]', source),
             '[DATE]', '2020') AS prompt,
             '### START: ' || array_to_string(w[greatest(len(w) - 1999, 1):], ' ') ||
             chr(10) || chr(10) || '### END: ' || array_to_string(w[1:2000], ' ') AS context
           FROM (SELECT doc_id, source, n_chars AS n,
             list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '') AS w FROM documents)""",
)
def fill_prompt(spark, sf):
    values = {"length": F.col("n_chars"), "domain": F.col("source"), "date": F.lit("2020")}
    return corpus(spark, sf, "n_chars", "source").select(
        "doc_id",
        tx.fill_prompt(F.lit(TEMPLATE), values).alias("prompt"),
        tx.context_block(F.col("text"), F.col("text")).alias("context"),
    )


@query(
    "SC-27",
    sql=f"""SELECT doc_id, n AS n_words, least(n, 5000) AS text_length, least(n, 2000) AS prompt_length,
             floor(least(n, 5000) * 1.6)::BIGINT AS max_tokens, least(n, 5000) * 15 AS max_tokens_reasoning
           FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[{SPACE}]+'),
             lambda x: x <> '')) AS n FROM documents)""",
)
def length_columns(spark, sf):
    n = F.size(tx.split_whitespace(F.col("text"))).cast("bigint")
    counted = corpus(spark, sf).select("doc_id", n.alias("n_words"))
    capped = F.least("n_words", F.lit(5000))
    return counted.select(
        "doc_id",
        "n_words",
        capped.alias("text_length"),
        F.least("n_words", F.lit(2000)).alias("prompt_length"),
        F.floor(capped * 1.6).alias("max_tokens"),
        (capped * 15).alias("max_tokens_reasoning"),
    )


@query(
    "SC-30",
    sql="""SELECT event_id, (props->>'$.k')::BIGINT AS k,
           '{"type":"' || event_type || '","k":' || (props->>'$.k') || '}' AS packed FROM events""",
)
def json_column(spark, sf):
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, sf, "events").select(
        "event_id",
        k.alias("k"),
        F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("packed"),
    )


@query(
    "SC-31",
    sql="""WITH d AS (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE,
             INTERVAL 1 DAY))::DATE AS day FROM orders),
           c AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)
           SELECT day::VARCHAR AS day, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (day)""",
)
def daily_calendar(spark, sf):
    """Every day between the first and the last, newest first, with its rows."""
    orders = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    per_day = orders.groupBy("day").agg(F.count("*").alias("n"))
    days = per_day.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(
        F.explode(F.sequence("b", "a", F.expr("INTERVAL -1 DAY"))).alias("day")
    )
    return days.join(per_day, "day", "left").select(
        F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n")
    )
