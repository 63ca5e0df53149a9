"""Corpus readers: every format ends in (id, text, chunks, ...) columns."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.operators.rows import SPLITS


def read_jsonl_corpus(spark: SparkSession, paths: Sequence[str], fields: str = "") -> DataFrame:
    """JSON lines with a ``facts`` list: the facts are the chunks, their lines
    the text.  ``fields`` names further columns as DDL."""
    schema = "facts ARRAY<STRING>" + (f", {fields}" if fields else "")
    rows = spark.read.schema(schema).json(list(paths))
    return rows.withColumn("text", F.array_join("facts", "\n")).withColumnRenamed("facts", "chunks")


def read_csv_corpus(spark: SparkSession, path: str, schema: str, **constants: str) -> DataFrame:
    """CSV with header and quoted line breaks, plus constant columns."""
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return rows.withColumns({n: F.lit(v) for n, v in constants.items()})


PROTOCOL = """Protocol STRUCT<Date: STRING>,
  NLPSpeeches ARRAY<STRUCT<Id: STRING, Text: STRING, Segments: ARRAY<STRUCT<Text: STRING>>>>"""


def read_protocols(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested protocols -> one row per speech, dated by its protocol."""
    protocols = spark.read.schema(PROTOCOL).option("multiLine", multi_line).json(path)
    speeches = protocols.select(
        F.col("Protocol.Date").alias("date"), F.explode("NLPSpeeches").alias("s")
    )
    return speeches.select(
        F.col("s.Id").alias("id"),
        "date",
        F.col("s.Text").alias("text"),
        F.col("s.Segments.Text").alias("chunks"),
    )


def parse_verse_lines(lines: DataFrame, default_book: str) -> DataFrame:
    """``Book c:v text`` or ``c:v text`` -> typed columns; other lines are dropped."""
    pattern = r"^(?:(\S+) )?(\d+):(\d+) (.*\S)\s*$"

    def part(i: int) -> Column:
        return F.regexp_extract("value", pattern, i)

    parsed = lines.select(
        F.when(part(1) == "", default_book).otherwise(part(1)).alias("book"),
        part(2).try_cast("int").alias("chapter"),
        part(3).try_cast("int").alias("verse"),
        part(4).alias("text"),
    )
    return parsed.where("chapter IS NOT NULL AND verse IS NOT NULL")


class _Article(HTMLParser):
    """Text of paragraphs, sub-headings and list entries, the canonical link
    and the two JSON blocks of a page."""

    BLOCKS = ("p", "h3", "li")
    VOID = ("br", "img", "meta", "link", "input", "hr", "source", "wbr")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.canonical: str | None = None
        self.json: dict[str, str] = {}
        self.blocks: list[tuple[bool, str]] = []
        self._open: list[str] | None = None
        self._script: str | None = None
        self._hidden = self._wrapped = 0
        self._stack: list[tuple[str, bool]] = []

    def _close_block(self) -> None:
        if self._open is not None:
            self.blocks.append((self._wrapped > 0, "".join(self._open)))
            self._open = None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "link" and given.get("rel") == "canonical" and self.canonical is None:
            self.canonical = given.get("href")
        if tag == "script":
            self._script = given.get("type") or ""
        elif tag == "style":
            self._hidden += 1
        if tag in self.VOID:
            return
        if tag in self.BLOCKS:
            self._close_block()
            self._open = []
        wraps = "word-wrap" in (given.get("class") or "").split()
        self._wrapped += wraps
        if tag not in self.BLOCKS:
            self._stack.append((tag, wraps))

    def handle_endtag(self, tag):
        if tag == "script":
            self._script = None
        elif tag == "style":
            self._hidden = max(0, self._hidden - 1)
        if tag in self.BLOCKS:
            self._close_block()
            return
        if any(t == tag for t, _ in self._stack):
            if tag in ("div", "main", "article", "section", "ul", "ol", "body", "nav"):
                self._close_block()
            while self._stack:
                name, wraps = self._stack.pop()
                self._wrapped -= wraps
                if name == tag:
                    break

    def handle_data(self, data):
        if self._script is not None:
            if self._script:
                self.json.setdefault(self._script, data)
        elif self._open is not None and not self._hidden:
            self._open.append(data)

    def text(self) -> str:
        """Blocks of the article body where the page marks one, else all."""
        marked = [t for inside, t in self.blocks if inside]
        return "\n".join(marked or [t for _, t in self.blocks])


def _entries(raw: str | None) -> str | None:
    """JSON-LD as one object keyed by type, so Spark can read it with a schema."""
    try:
        entries = json.loads(raw) if raw else []
    except ValueError:
        return None
    by_type = {}
    for entry in entries if isinstance(entries, list) else [entries]:
        if isinstance(entry, dict):
            kinds = entry.get("@type")
            by_type.update((k, entry) for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str))
    return json.dumps(by_type)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for page_id, html in zip(batch["page_id"], batch["html"]):
            page = _Article()
            page.feed(html or "")
            page.close()
            page._close_block()
            out.append(
                (
                    page_id,
                    page.canonical,
                    page.text(),
                    _entries(page.json.get("application/ld+json")),
                    page.json.get("application/settings+json"),
                )
            )
        yield pd.DataFrame(out, columns=["page_id", "canonical", "raw", "ld", "settings"])


LD = """NewsArticle STRUCT<dateCreated: STRING, dateModified: STRING, datePublished: STRING>,
  BreadcrumbList STRUCT<itemListElement: ARRAY<STRUCT<item: STRUCT<name: STRING>>>>"""
SETTINGS = """editorial STRUCT<author: ARRAY<STRING>, info: STRUCT<article_id: STRING, channel: STRING,
  subchannel: STRING, headline: STRING, headline_social: STRING, intro: STRING, topics: ARRAY<STRING>>>"""


def extract_articles(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> article columns; absent JSON blocks give NULL fields."""
    parsed = pages.select("page_id", "html").mapInPandas(
        _parse, "page_id BIGINT, canonical STRING, raw STRING, ld STRING, settings STRING"
    )
    ld, info = F.from_json("ld", LD), F.from_json("settings", SETTINGS)["editorial"]
    read = parsed.withColumns({"l": ld, "e": info})
    return read.select(
        "page_id",
        F.col("canonical").alias("url"),
        F.trim(F.regexp_replace("raw", r"\n+", "\n")).alias("text"),
        F.col("e.info.article_id").alias("id"),
        F.col("e.info.channel").alias("channel"),
        F.col("e.info.subchannel").alias("subchannel"),
        F.col("e.info.headline").alias("headline"),
        F.col("e.info.headline_social").alias("headline_social"),
        F.col("e.info.intro").alias("intro"),
        F.col("e.info.topics").alias("topics"),
        F.col("e.author").alias("author"),
        F.col("l.NewsArticle.dateCreated").alias("date_created"),
        F.col("l.NewsArticle.dateModified").alias("date_modified"),
        F.col("l.NewsArticle.datePublished").alias("date_published"),
        F.col("l.BreadcrumbList.itemListElement.item.name").alias("breadcrumbs"),
    )


STANDOFF = """_id BIGINT, title STRING, sofa STRING,
  paragraph ARRAY<STRUCT<_begin: INT, _end: INT>>"""


def read_standoff(spark: SparkSession, path: str, row_tag: str = "document") -> DataFrame:
    """Annotated XML (bzip2 is read directly): paragraphs are the covered
    character ranges, the text is the title and the paragraphs by line."""
    rows = (
        spark.read.format("xml")
        .schema(STANDOFF)
        .option("rowTag", row_tag)
        .option("ignoreSurroundingSpaces", False)
        .load(path)
    )
    covered = F.transform(
        "paragraph",
        lambda p: F.substring(F.col("sofa"), p["_begin"] + 1, p["_end"] - p["_begin"]),
    )
    cut = rows.select(F.col("_id").alias("id"), "title", covered.alias("chunks"))
    return cut.select("id", F.concat_ws("\n", "title", F.array_join("chunks", "\n")).alias("text"), "chunks")


def read_split_dirs(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """``train``, ``test`` and ``eval`` folders of several data sets, united by
    split; a split that a data set lacks is skipped."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    whole = None
    for folder in folders:
        for split in SPLITS:
            path = f"{folder}/{split}"
            at = hadoop(path)
            if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                continue
            part = spark.read.parquet(path).withColumn("split", F.lit(split))
            whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    if whole is None:
        raise FileNotFoundError(f"no split folder below {list(folders)}")
    return whole


def load_metric_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files ``{dataset: {metric: value}}``, one per model -> (model,
    dataset, metric, value); the model is the file's ``model=`` folder, else
    its name without ending."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"model=([^/]+)/", 1)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"\A(.*?)(?:\.[^.]*)?\z", 1)
    raw = spark.read.option("wholetext", True).text(path).select(
        F.coalesce(F.nullif(folder, F.lit("")), name).alias("model"), "value"
    )
    reports = raw.select(
        "model", F.from_json("value", "MAP<STRING, MAP<STRING, DOUBLE>>").alias("report")
    )
    return reports.select("model", F.explode("report").alias("dataset", "metrics")).select(
        "model", "dataset", F.explode("metrics").alias("metric", "value")
    )


def metric_table(reports: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """(model, metric) rows by data set columns."""
    return reports.groupBy("model", "metric").pivot("dataset", list(datasets)).agg(F.max("value"))


def with_type_table(df: DataFrame, types: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Join a constant (key -> value type, comment) table."""
    rows = [(k, t, c) for k, (t, c) in types.items()]
    lookup = df.sparkSession.createDataFrame(rows, "key string, value_type string, comment string")
    return df.join(F.broadcast(lookup), "key")
