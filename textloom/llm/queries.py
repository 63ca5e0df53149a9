"""The opN queries: production parameters over the whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import (
    collocations,
    language,
    line_dedup,
    mixing,
    near_dup,
    nearest,
    pii,
    quality_model,
    quality_rules,
    sentencepiece_bpe,
    sharding,
    spelling,
    url_rules,
)
from textloom.llm.sql import ORACLES  # noqa: F401
from textloom.session import table

#: Languages of the corpus.
LANGUAGES = ("de", "en", "es", "fr")

#: The rules that the URL query is asked to apply.
URL_RULES = (
    url_rules.Rule("block", "com", "/en/"),
    url_rules.Rule("allow", "example.com", "/en/7"),
    url_rules.Rule("allow", "net", "/de/"),
    url_rules.Rule("block", "example.net", "/de/8"),
    url_rules.Rule("block", "org", "/es/"),
)


def sentencepiece_model() -> str:
    """Path of the vocabulary file, the same on every worker; SENTENCEPIECE_MODEL overrides it."""
    given = os.environ.get("SENTENCEPIECE_MODEL")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), sentencepiece_model())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.remove_repeats(docs)
    return found.select("doc_id", "text", F.col("__n_chunks").alias("n_chunks"), F.col("__n_removed").alias("n_removed"))


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages from their first to their last line; the cut of op3_line_dedup is that of its SQL check."""
    found = line_dedup.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id",
        *quality_rules.MEASURES,
        "fail_bits",
        (~quality_rules.passes(quality_rules.POLICIES["base-1"])).alias("base_failed"),
        quality_rules.passes(quality_rules.POLICIES["full-1"]).alias("kept"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.select(F.col("__id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = language.identify(docs, "text", LANGUAGES, declared=F.col("lang"), host=F.col("source"))
    return found.select(
        "doc_id",
        F.col("__lang").alias("language"),
        F.col("__posterior").alias("posterior"),
        F.col("__accepted").alias("kept"),
    )


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fusion for raw pages: markup attribute, address suffix and host beside the text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    visible = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[a-z#0-9]+;", " ")
    pages = pages.select(
        "page_id",
        visible.alias("body"),
        language.markup_language(F.col("html")).alias("markup"),
        language.address_suffix(F.col("url")).alias("suffix"),
        language.address_host(F.col("url")).alias("host"),
    )
    found = language.identify(pages, "body", LANGUAGES, F.col("markup"), F.col("host"), F.col("suffix"))
    return found.select(
        "page_id",
        F.col("__lang").alias("language"),
        F.col("__posterior").alias("posterior"),
        F.col("__accepted").alias("kept"),
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs)
    spans = F.col("__spans")

    def of(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["order"] < len(pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[of(kind) for kind in pii.BASE_KINDS],
        F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"),
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Regions, racks a region and shards a rack of the 24 shards.
SHARD_TREE = sharding.Tree.even(3, 2, 4)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_TREE)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", "grown_shard", "region", "rack"
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), noise=spelling.NOISE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nearest,
        op2_sentencepiece,
        op3_line_dedup,
        op4_quality_rules,
        op5_mixing,
        op6_near_duplicates,
        op7_language,
        op8_personal_data,
        op9_url_rules,
        op10_quality_model,
        op11_shards,
        op12_collocations,
        op13_spelling_variants,
        page_languages,
        passage_dedup,
    )
}
