"""Formats, stores and streams on small inputs."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from textloom.functions.tokens import offset_table, with_token_offsets
from textloom.operators.arrays import trajectory_spectrum
from textloom.operators.processors import Processor
from textloom.session import scratch_path
from textloom.sources import readers, store, writers
from textloom.streaming import jobs

ARTICLE = """<html><head><link rel="canonical" href="https://x.y/a"><style>p{}</style>
<script type="application/ld+json">[{"@type":"NewsArticle","dateCreated":"2020-01-02","datePublished":"2020-01-03"},
{"@type":"BreadcrumbList","itemListElement":[{"item":{"name":"Home"}},{"item":{"name":"News"}}]}]</script>
<script type="application/settings+json">{"editorial":{"author":["A B"],"info":{"article_id":"7","channel":"c","headline":"H"}}}</script>
</head><body><nav><ul><li>menu</li></ul></nav><main><div class="word-wrap"><p>One &amp; two<b>!</b></p>
<h3>Head</h3><ul><li>first<li>second</ul></div></main><p>footer</p></body></html>"""


def test_article(spark):
    pages = spark.createDataFrame([(1, ARTICLE), (2, "<p>a</p><p>b<br>c"), (3, None)], "page_id long, html string")
    found = {r["page_id"]: r for r in readers.extract_articles(pages).collect()}
    one = found[1]
    assert one["text"] == "One & two!\nHead\nfirst\nsecond"
    assert (one["url"], one["id"], one["headline"], one["author"]) == ("https://x.y/a", "7", "H", ["A B"])
    assert (one["date_created"], one["date_modified"], one["breadcrumbs"]) == ("2020-01-02", None, ["Home", "News"])
    assert found[2]["text"] == "a\nbc" and found[2]["url"] is None and found[3]["text"] == ""


def test_verse_lines(spark):
    lines = spark.createDataFrame([("Gen 1:2 In the",), ("3:4 text",), ("x y z",), ("1:a b",), ("",)], "value string")
    assert rows(readers.parse_verse_lines(lines, "Genesis")) == [("Gen", 1, 2, "In the"), ("Genesis", 3, 4, "text")]


def test_multi_line_protocol(spark, tmp_path):
    protocol = {"Protocol": {"Date": "2020-05-06"}, "NLPSpeeches": [{"Id": "s1", "Text": "t", "Segments": [{"Text": "a"}, {"Text": "b"}]}]}
    (tmp_path / "p.json").write_text(json.dumps(protocol, indent=2))
    assert rows(readers.read_protocols(spark, str(tmp_path), multi_line=True)) == [("s1", "2020-05-06", "t", ["a", "b"])]


@pytest.mark.parametrize("text", ['quote " and, comma', "line\nbreak", "  spaces ", "ctrl\u0001\u000b x", "ünï ]]> <b>&amp;"])
def test_round_trips(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    clean = docs.withColumn("text", writers.xml_safe(F.col("text"))).first()["text"]
    path = scratch_path(spark, "xml")
    writers.write_xml_documents(docs, path)
    xml = spark.read.format("xml").schema("doc_id long, text string").option("rowTag", "document").option("ignoreSurroundingSpaces", False).load(path)
    assert rows(xml) == [(1, clean)]
    path = scratch_path(spark, "json")
    writers.write_chunked(docs, path, 10)
    assert rows(spark.read.schema("doc_id long, text string").json(path)) == [(1, text)]


def test_insert_and_update(spark):
    path = scratch_path(spark, "store")
    spark.createDataFrame([(1, "old")], "id long, v string").write.parquet(path)
    batch = spark.createDataFrame([(1, "new"), (2, "a"), (2, "b")], "id long, v string")
    for _ in range(2):
        store.insert_if_absent(path, batch, "id", order=["v"])
    assert rows(spark.read.parquet(path)) == [(1, "old"), (2, "a")]
    updates = spark.createDataFrame([(2, None), (9, "z")], "id long, v string")
    assert rows(store.update_by_key(spark.read.parquet(path), updates, "id")) == [(1, "old"), (2, None)]


def test_publish_again_replaces_only_its_folders(spark):
    path = scratch_path(spark, "hub")
    df = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x")], "id_sample string, config string, agent string")
    writers.publish(df, path)
    writers.publish(df.where("config = 'a'").withColumn("id_sample", F.lit("9")), path)
    assert rows(spark.read.parquet(path), "id_sample") == [("2",), ("9",)]


def test_processor_checks_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    keep = Processor(pre=lambda d: d, required=("a",), added=("b",))
    with pytest.raises(ValueError):
        keep.pre_process(df)
    with pytest.raises(KeyError):
        Processor(pre=lambda d: d, required=("z",)).pre_process(df)


def test_repeated_micro_batch_replaces_its_folder(spark):
    inbox, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    df.repartition(2, "doc_id").write.parquet(inbox)
    for _ in range(2):  # a new checkpoint folder: every batch runs again
        rows_ = jobs.read_files(spark, inbox, df.schema, files_per_trigger=1)
        jobs.stream_features(rows_, lambda b: b.withColumn("n", F.length("text")), out, scratch_path(spark, "at"))
    assert rows(spark.read.parquet(out), "doc_id", "n") == [(1, 3), (2, 1)]


def test_feature_stream_resumes(spark, tmp_path):
    """Stop, new files, start again: every row is processed once."""
    inbox, out, offsets = (str(tmp_path / x) for x in ("inbox", "out", "offsets"))
    schema = "doc_id long, text string"
    for new in ((1, "a b"), (2, "c"), (3, None)):
        spark.createDataFrame([new], schema).coalesce(1).write.mode("append").parquet(inbox)
        rows_ = jobs.read_files(spark, inbox, spark.read.parquet(inbox).schema)
        jobs.stream_features(rows_, lambda b: b.withColumn("n", F.length("text")), out, offsets)
    assert rows(spark.read.parquet(out), "doc_id", "n") == [(1, 3), (2, 1), (3, None)]


def test_inserting_stream_resumes(spark, tmp_path):
    inbox, kept, offsets = (str(tmp_path / x) for x in ("inbox", "kept", "offsets"))
    df = spark.sql("SELECT 1 AS k, TIMESTAMP '2020-01-01 00:00:00' AS t")
    df.limit(0).write.parquet(kept)
    for sql in ("SELECT 1 AS k", "SELECT explode(array(1, 2)) AS k"):
        spark.sql(sql).withColumn("t", F.lit("2020-01-01").cast("timestamp")).write.mode("append").parquet(inbox)
        jobs.stream_insert_if_absent(jobs.read_files(spark, inbox, df.schema), kept, "k", "t", offsets)
        jobs.stream_insert_if_absent(jobs.read_files(spark, inbox, df.schema), kept, "k", "t", offsets)
    assert rows(spark.read.parquet(kept), "k") == [(1,), (2,)]


def test_article_with_several_types_and_all_fields(spark):
    html = ARTICLE.replace('"@type":"NewsArticle"', '"@type":["Article","NewsArticle",null]').replace(
        '"channel":"c"', '"channel":"c","subchannel":"s","headline_social":"x","intro":"i","topics":["a","b"]'
    )
    one = readers.extract_articles(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (one["date_created"], one["subchannel"], one["headline_social"]) == ("2020-01-02", "s", "x")
    assert (one["intro"], one["topics"]) == ("i", ["a", "b"])


def test_reports_are_named_by_file_or_folder(spark, tmp_path):
    (tmp_path / "model=m").mkdir()
    for name, value in (("a.json", 0.9), ("b.v2.json", 0.4), ("model=m/part-0.txt", 0.1)):
        (tmp_path / name).write_text(json.dumps({"en": {"f1": value}}))
    reports = readers.load_metric_reports(spark, str(tmp_path / "*.json")).unionByName(
        readers.load_metric_reports(spark, str(tmp_path / "model=m"))
    )
    assert rows(reports, "model", "value") == [("a", 0.9), ("b.v2", 0.4), ("m", 0.1)]


def test_missing_texts_and_matrices_give_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "ab c")], "doc_id long, text string")
    assert rows(offset_table(docs)) == [(3, 0, 0, 2, "ab"), (3, 1, 3, 4, "c")]
    assert [len(r["offsets"]) for r in with_token_offsets(docs).orderBy("doc_id").collect()] == [0, 0, 2]
    data = [(1, None), (2, []), (3, [[1.0, 3.0], [0.0, 0.0]])]
    spectrum = trajectory_spectrum(spark.createDataFrame(data, "k long, m array<array<double>>"), "k", "m")
    assert rows(spectrum) == [(3, 0.5, 4.0)]
