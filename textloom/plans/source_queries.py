"""Formats and stores: the tables are written to the shared folder, read back
by the reader under test and compared with the table itself."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Window, functions as F

from textloom.operators.evaluation import confusion_at
from textloom.operators.ranking import collect_parts
from textloom.plans.registry import SAMPLES, SCORED, corpus, query, r6, samples, scored
from textloom.plans.row_queries import SPLIT_SQL, hash_split
from textloom.session import scratch_path, table
from textloom.sources import committed, readers, store, writers


def documents(spark, sf, *columns):
    return corpus(spark, sf, *columns)


@query(
    "IO-01",
    sql=f"""SELECT doc_id, text, len(string_split(text, chr(10))) AS n_chunks FROM documents
            WHERE {SPLIT_SQL} IN ('train', 'test')""",
)
def read_jsonl_corpus(spark, sf):
    path = scratch_path(spark, "jsonl")
    facts = documents(spark, sf).select(
        "doc_id", F.split("text", "\n").alias("facts"), hash_split().alias("split")
    )
    facts.write.partitionBy("split").json(path)
    corpus = readers.read_jsonl_corpus(
        spark, [f"{path}/split=train", f"{path}/split=test"], fields="doc_id BIGINT"
    )
    return corpus.select("doc_id", "text", F.size("chunks").cast("bigint").alias("n_chunks"))


@query(
    "IO-02",
    sql="SELECT doc_id, text, 'csv' AS domain, '2007-2015' AS date, 'en-EN' AS lang FROM documents",
)
def read_csv_corpus(spark, sf):
    path = scratch_path(spark, "csv")
    (
        documents(spark, sf).write.option("header", True).option("quoteAll", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return readers.read_csv_corpus(
        spark, path, "doc_id BIGINT, text STRING", domain="csv", date="2007-2015", lang="en-EN"
    )


@query(
    "IO-03",
    sql=f"""SELECT id_sample AS id, '2020-' || id_source AS date, text,
              array_to_string(string_split(text, '.'), '|') AS chunks FROM {SAMPLES}""",
)
def flatten_nested_protocol(spark, sf):
    path = scratch_path(spark, "protocols")
    speech = F.struct(
        F.col("id_sample").alias("Id"),
        F.col("text").alias("Text"),
        F.transform(F.split("text", r"\."), lambda t: F.struct(t.alias("Text"))).alias("Segments"),
    )
    nested = collect_parts(samples(spark, sf), ["id_source"], ["turn"], {"NLPSpeeches": speech})
    nested.select(
        F.struct(F.concat(F.lit("2020-"), F.col("id_source")).alias("Date")).alias("Protocol"), "NLPSpeeches"
    ).write.json(path)
    return readers.read_protocols(spark, path).withColumn("chunks", F.array_join("chunks", "|"))


LINE = r"regexp_replace(text, '\s+', ' ', 'g')"


@query(
    "IO-04",
    sql=rf"""SELECT CASE role WHEN 'user' THEN 'Gen' ELSE 'Genesis' END AS book, conv_id::INT AS chapter, turn::INT AS verse,
              regexp_replace({LINE}, '\s+$', '') AS text FROM conversations WHERE role <> 'system'""",
)
def parse_verse_lines(spark, sf):
    """User turns carry a book, assistant turns none, system turns are malformed."""
    path = scratch_path(spark, "verses")
    body = F.regexp_replace("text", r"\s+", " ")
    label = F.concat_ws(":", "conv_id", "turn")
    line = (
        F.when(F.col("role") == "user", F.concat_ws(" ", F.lit("Gen"), label, body))
        .when(F.col("role") == "assistant", F.concat_ws(" ", label, body))
        .otherwise(F.concat(F.lit("1:x "), body))
    )
    table(spark, sf, "conversations").select(line.alias("value")).write.text(path)
    return readers.parse_verse_lines(spark.read.text(path), default_book="Genesis")


@query("IO-05")
def extract_article_html(spark, sf):
    return readers.extract_articles(table(spark, sf, "pages"))


@query(
    "IO-06",
    sql="""SELECT doc_id AS id, 'Title ' || doc_id || chr(10) || text AS text, len(string_split(text, chr(10))) AS n_chunks
           FROM documents""",
)
def standoff_covered_text(spark, sf):
    """Lines as annotated character ranges over the text, bzip2-compressed XML."""
    path = scratch_path(spark, "standoff")
    lines = documents(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")
    placed = lines.select("doc_id", "pos", begin.alias("begin"), F.length("line").alias("n"))
    ranges = placed.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "begin", "n"))).alias("r")
    )
    annotated = documents(spark, sf).join(ranges, "doc_id").select(
        F.col("doc_id").alias("_id"),
        F.concat(F.lit("Title "), F.col("doc_id")).alias("title"),
        F.col("text").alias("sofa"),
        F.transform(
            "r", lambda x: F.struct(x["begin"].alias("_begin"), (x["begin"] + x["n"]).alias("_end"))
        ).alias("paragraph"),
    )
    (
        annotated.write.format("xml").option("rootTag", "documents").option("rowTag", "document")
        .option("compression", "bzip2").save(path)
    )
    read = readers.read_standoff(spark, path)
    return read.select("id", "text", F.size("chunks").cast("bigint").alias("n_chunks"))


@query("IO-10", sql="SELECT doc_id, text, lang FROM documents")
def write_chunked(spark, sf):
    path = scratch_path(spark, "chunked")
    writers.write_chunked(documents(spark, sf, "lang"), path, records_per_file=300)
    return spark.read.schema("doc_id BIGINT, text STRING, lang STRING").json(path)


@query("IO-11", sql="SELECT doc_id, text, source AS domain FROM documents")
def export_jsonl_bz2(spark, sf):
    path = scratch_path(spark, "export")
    docs = documents(spark, sf, F.col("source").alias("domain"))
    writers.export_jsonl_bz2(docs, path, "domain", spread=["doc_id"], rows_per_file=20)
    return spark.read.schema("doc_id BIGINT, text STRING, domain STRING").json(path)


@query(
    "IO-12",
    sql=f"""SELECT id_sample, text, label, agent, CASE WHEN turn = 0 THEN 'opening' ELSE 'reply' END AS config FROM {SAMPLES}""",
)
def publish_by_config_and_agent(spark, sf):
    path = scratch_path(spark, "hub")
    config = F.when(F.col("turn") == 0, "opening").otherwise("reply")
    rows = samples(spark, sf).select("id_sample", "text", "label", "agent", config.alias("config"))
    writers.publish(rows, path)
    writers.publish(rows.where("config = 'reply'"), path)
    return spark.read.parquet(path)


def _store(spark, sf):
    """A store that holds the labels of quality 1."""
    path = scratch_path(spark, "store")
    table(spark, sf, "labels").where("quality = 1").write.parquet(path)
    return path


@query(
    "IO-14",
    sql="SELECT doc_id, quality, CASE quality WHEN 1 THEN toxic ELSE 7 END AS toxic FROM labels",
)
def insert_if_absent(spark, sf):
    """Every label arrives twice with other values; only unseen ids go in."""
    path = _store(spark, sf)
    labels = table(spark, sf, "labels")
    batch = labels.withColumn("toxic", F.lit(7)).unionByName(labels.withColumn("toxic", F.lit(8)))
    store.insert_if_absent(path, batch, "doc_id", order=["toxic"])
    return spark.read.parquet(path)


@query(
    "IO-15",
    sql="SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 UNION ALL SELECT * FROM labels",
)
def append_many(spark, sf):
    path = _store(spark, sf)
    store.append_many(path, table(spark, sf, "labels"))
    return spark.read.parquet(path)


@query(
    "IO-16",
    sql="""SELECT doc_id, quality, CASE WHEN lang = 'en' THEN NULL WHEN lang = 'de' THEN 5 ELSE toxic END AS toxic
           FROM labels JOIN documents USING (doc_id)""",
)
def update_by_key(spark, sf):
    docs = table(spark, sf, "documents").where("lang IN ('en', 'de')")
    updates = docs.select("doc_id", F.when(F.col("lang") == "de", 5).alias("toxic"))
    return store.update_by_key(table(spark, sf, "labels"), updates, "doc_id")


@query(
    "IO-17",
    sql="""SELECT doc_id, 'open' AS run FROM documents ANTI JOIN labels USING (doc_id)
           UNION ALL SELECT doc_id, 'force' FROM documents""",
)
def resume_unprocessed(spark, sf):
    docs, done = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    rest = store.resume_unprocessed(docs, done, "doc_id")
    whole = store.resume_unprocessed(docs, done, "doc_id", force=True)
    return rest.withColumn("run", F.lit("open")).unionByName(whole.withColumn("run", F.lit("force")))


@query(
    "IO-18",
    sql="SELECT doc_id, lang, text || 'end' AS text FROM documents",
)
def write_xml_documents(spark, sf):
    """Control characters are added and must be gone after the round trip."""
    path = scratch_path(spark, "xml")
    dirty = F.concat("text", F.lit("\u0001e\u000bnd"))
    writers.write_xml_documents(documents(spark, sf, "lang").withColumn("text", dirty), path)
    return (
        spark.read.format("xml").schema("doc_id BIGINT, lang STRING, text STRING")
        .option("rowTag", "document").option("ignoreSurroundingSpaces", False).load(path)
    )


# The described fields, their value types and comments.
FIELDS = {
    "lang": ("Enum", "language of the document"),
    "source": ("String", "where the document comes from"),
    "n_chars": ("Number", "length of the text"),
}


@query(
    "IO-19",
    sql=" UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS key, {k}::VARCHAR AS value, '{t}' AS value_type, '{c}' AS comment FROM documents"
        for k, (t, c) in FIELDS.items()
    ),
)
def metadata_key_values(spark, sf):
    tall = store.metadata_key_values(table(spark, sf, "documents"), "doc_id", list(FIELDS))
    return readers.with_type_table(tall, FIELDS)


@query(
    "IO-20",
    sql=f"""SELECT doc_id, {SPLIT_SQL} AS split, 'a' AS origin FROM documents
            UNION ALL SELECT item_id, 'test', 'b' FROM benchmark""",
)
def read_split_dirs(spark, sf):
    first, second = scratch_path(spark, "splits"), scratch_path(spark, "splits")
    docs = table(spark, sf, "documents").select("doc_id", hash_split().alias("s"), F.lit("a").alias("origin"))
    for split in ("train", "eval", "test"):
        docs.where(F.col("s") == split).drop("s").write.parquet(f"{first}/{split}")
    table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.lit("b").alias("origin")
    ).write.parquet(f"{second}/test")
    return readers.read_split_dirs(spark, [first, second])


@query(
    "IO-21",
    sql=f"""SELECT model, metric, max(v) FILTER (lang = 'en') AS en, max(v) FILTER (lang = 'de') AS de,
              max(v) FILTER (lang = 'es') AS es, max(v) FILTER (lang = 'fr') AS fr FROM (
              SELECT model, lang, 'accuracy' AS metric, round(avg(((y_score >= thr)::INT = y_true)::INT), 6) AS v
              FROM {SCORED}, (SELECT unnest(['low', 'high']) AS model, unnest([0.3, 0.7]::DOUBLE[]) AS thr)
              GROUP BY ALL UNION ALL SELECT model, lang, 'n_samples', count(*)::DOUBLE FROM {SCORED},
              (SELECT unnest(['low', 'high']) AS model) GROUP BY ALL) GROUP BY model, metric""",
)
def load_metric_reports(spark, sf):
    """Reports are written by one job per model and read back as one table."""
    path = scratch_path(spark, "reports")
    cells = confusion_at(scored(spark, sf), ["lang"], {"low": 0.3, "high": 0.7})
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    metrics = F.create_map(
        F.lit("accuracy"), r6((F.col("tn") + F.col("tp")) / n), F.lit("n_samples"), n.cast("double")
    )
    report = F.map_from_entries(F.collect_list(F.struct("lang", metrics.alias("m"))))
    reports = cells.groupBy("model").agg(F.to_json(report).alias("value"))
    reports.repartition("model").write.partitionBy("model").text(path)
    return readers.metric_table(readers.load_metric_reports(spark, path), ["en", "de", "es", "fr"])


@query(
    "IO-22",
    sql="""SELECT doc_id AS id, CASE WHEN quality IS NOT NULL THEN round(n_chars / (n_chars + 1000.0::DOUBLE), 3) END AS score
           FROM documents LEFT JOIN labels USING (doc_id)""",
)
def write_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    template = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    scores = scored(spark, sf).select(F.col("doc_id").alias("id"), F.col("y_score").alias("score"))
    writers.write_predictions(writers.fill_predictions(template, scores, decimals=3), path)
    return spark.read.schema("id BIGINT, score DOUBLE").json(path)


@query(
    "IO-10",
    "IO-13",
    sql="SELECT 'json' AS form, count(*) AS n, count(*) AS read_back, true AS dated FROM documents",
)
def committed_export(spark, sf):
    """Documents through the committing sink: totals and time of its manifest, and the rows that it names."""
    docs = corpus(spark, sf, "lang", "source")
    path = scratch_path(spark, "committed")
    started = datetime.now(timezone.utc)
    committed.write_committed(docs, path)
    back = committed.read_committed(spark, path, docs.schema).agg(F.count_distinct("doc_id").alias("read_back"))
    found = committed.manifests(spark, path).select(
        "form", F.col("rows").alias("n"), (F.col("collected_at") >= F.lit(started)).alias("dated")
    )
    return found.crossJoin(F.broadcast(back)).select("form", "n", "read_back", "dated")  # one row each
