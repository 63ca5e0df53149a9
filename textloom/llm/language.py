"""Language identification by Bayesian fusion of four kinds of evidence.

* text: a naive Bayes model over byte trigrams, fitted on a bounded sample of
  rows with a declared language;
* the declared language of the row (markup attribute or metadata), believed as
  far as it agrees with the text across the corpus;
* the suffix of the address (``.fr``, or ``/fr/`` at the start of the path),
  believed in the same way;
* the host: how often each language occurs on it, smoothed towards its parent
  domain and that towards the whole corpus.

The last three are tables counted by grouped aggregation over all rows.

None of them says that a text is in one of the languages at all.  That is
decided against evenly spread trigrams: how far the texts of a language lie
above them is measured on one half of the sample by the model of the other, and
a text that stays below a share of that way in every language is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.session import materialize

#: Declared texts used for fitting per language, about; a hash of the text chooses them.
TRAIN_ROWS = 1_500
BUCKETS = 1 << 15
#: Neighbouring trigrams overlap, so their evidence is discounted; beyond this
#: many trigrams a text cannot be surer.
DISCOUNT, FULL_TRIGRAMS = 0.1, 2_000
#: Pseudo-rows of the parent in a child's prior, and of a uniform table in the rest.
HOST_ROWS, TABLE_ROWS = 20.0, 2.0
MIN_POSTERIOR = 0.5
#: Log-likelihood of a trigram if all buckets are equally likely.
EVEN = -float(np.log(BUCKETS))
#: Share of the way from EVEN to what is usual for a language that a text must reach, the second
#: if its declared language is none of the known; standard errors by which short texts may miss it.
LEAST_FITS, SLACK = (0.5, 0.75), 2.0


def trigram_buckets(raw: bytes) -> np.ndarray:
    """Buckets of all byte trigrams of a text, white space and digits as one blank, A-Z lowered."""
    table = np.arange(256, dtype=np.uint32)
    table[65:91] += 32
    table[:65] = 32
    codes = table[np.frombuffer(b" " + raw + b" ", np.uint8)]
    if len(codes) < 3:
        return np.zeros(0, np.uint32)
    mixed = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA77)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
    keep = (codes[:-2] != 32) | (codes[1:-1] != 32) | (codes[2:] != 32)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(17))[keep] % np.uint32(BUCKETS)


def text_model(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood of every bucket in every language, from counts, languages x buckets."""
    smooth = counts + 0.5
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


def usual_fit(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per language how far a trigram lies above EVEN on average, and its deviation.

    From counts, halves x languages x buckets: each half is measured by the
    model of the other.  -inf for a language without texts.
    """
    counts = halves.sum(axis=2).sum(axis=0)
    models = [text_model(half) for half in halves[::-1]]
    size = np.maximum(counts, 1.0)
    mean = sum((half * model).sum(axis=1) for half, model in zip(halves, models)) / size
    square = sum((half * model**2).sum(axis=1) for half, model in zip(halves, models)) / size
    above = np.where(counts > 0, np.maximum(mean - EVEN, 0.0), -np.inf)
    return above, np.sqrt(np.maximum(square - mean**2, 0.0))


def text_margins(mean: np.ndarray, n: int, above: np.ndarray, deviation: np.ndarray) -> list[float]:
    """For each of LEAST_FITS by how much a text passes it in the language that suits it best.

    ``mean`` has the log-likelihood per trigram and language, ``n`` is the number of trigrams.
    """
    known = np.isfinite(above)
    if not known.any():
        return [0.0] * len(LEAST_FITS)  # nothing learned, nothing to reject by
    way = mean[known] - EVEN + SLACK * deviation[known] / np.sqrt(n)
    return [float((way - share * above[known]).max()) for share in LEAST_FITS]


def text_evidence(
    model: np.ndarray, raw: bytes | None, above: np.ndarray, deviation: np.ndarray
) -> list[float] | None:
    """Discounted log-likelihood per language over the whole text, the best being 0, then the margins of the text.

    None without a letter.
    """
    buckets = trigram_buckets(raw or b"")
    if not len(buckets):
        return None
    total = model[:, buckets].sum(axis=1)
    margins = text_margins(total / len(buckets), len(buckets), above, deviation)
    total *= DISCOUNT * min(1.0, FULL_TRIGRAMS / len(buckets))
    return (total - total.max()).tolist() + margins


def address_host(url: Column) -> Column:
    """Host of an address, lower case; null without ``://``."""
    host = F.regexp_extract(F.lower(url), r"\A[^:/?#]*://([^/?#:]*)", 1)
    return F.when(host != "", host)


def address_suffix(url: Column) -> Column:
    """Two-letter hint of an address: the country ending, else a path that starts with a two-letter folder."""
    low = F.lower(url)
    ending = F.regexp_extract(low, r"\A[^:/?#]*://[^/?#]*\.([a-z]{2})(?::[0-9]+)?(?:[/?#]|\z)", 1)
    folder = F.regexp_extract(low, r"\A[^:/?#]*://[^/?#]*/([a-z]{2})(?:/|\z)", 1)
    return F.when(ending != "", ending).when(folder != "", folder)


def parent_host(host: Column) -> Column:
    """The last two labels of a host; a host without a dot is its own parent."""
    return F.regexp_extract(host, r"([^.]*(?:\.[^.]*)?)\z", 1)


def markup_language(html: Column) -> Column:
    """The ``lang`` attribute of the ``html`` tag, its first part in lower case; null if there is none."""
    found = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    return F.when(found != "", F.lower(found))


def _bucket_counts(rows: DataFrame, languages: Sequence[str], limit: int) -> np.ndarray:
    """Trigram counts, halves x languages x buckets, of about ``limit`` different texts per language.

    A hash of the text decides who is in the sample and in which half, so copies
    are in or out together and are then counted once.  Texts are counted where
    they are; a task hands on at most one row per half, language and bucket.
    """
    known = rows.where(F.col("__declared").isin(*languages))
    sizes = {r["__declared"]: r["count"] for r in known.groupBy("__declared").count().collect()}
    if not sizes:
        return np.zeros((2, len(languages), BUCKETS))
    space = 1 << 31
    share = F.coalesce(*[
        F.when(F.col("__declared") == x, F.lit(min(space, limit * space // n))) for x, n in sizes.items()
    ])
    sample = known.where(F.pmod(F.xxhash64("__text"), F.lit(space)) < share).select("__declared", "__text")
    half = F.shiftright(F.xxhash64("__text"), 40).bitwiseAND(1).cast("long")  # not a bit that chose the sample
    sample = sample.dropDuplicates().select("__declared", F.col("__text").cast("binary").alias("__text"), half.alias("__half"))
    place = {language: i for i, language in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, len(place), BUCKETS), np.int64)
        for batch in batches:
            for language, raw, half in zip(*batch.columns):
                of = place[language.as_py()]
                found[half.as_py(), of] += np.bincount(trigram_buckets(raw.as_py() or b""), minlength=BUCKETS)
        at = np.nonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (*at, found[at])], names=["half", "language", "bucket", "n"]
        )

    rows = sample.mapInArrow(count, "half long, language long, bucket long, n long")
    counts = np.zeros((2, len(languages), BUCKETS))
    # Bounded by halves x languages x buckets.
    for half, language, bucket, n in rows.groupBy("half", "language", "bucket").agg(F.sum("n")).collect():
        counts[half, language, bucket] = n
    return counts


def _shares(counts: DataFrame, keys: Sequence[str], languages: Sequence[str], out: str) -> DataFrame:
    """Per key the log share of the key's value given each language: log P(value | language)."""
    per_language = counts.groupBy().agg(
        *[F.sum(F.col("__n")[i]).alias(f"__t{i}") for i in range(len(languages))],
        F.countDistinct(*keys).alias("__values"),
    )
    summed = counts.groupBy(*keys).agg(*[F.sum(F.col("__n")[i]).alias(f"__c{i}") for i in range(len(languages))])
    flat = F.lit(TABLE_ROWS) / F.col("__values")
    shares = F.array(
        *[F.log((F.col(f"__c{i}") + flat) / (F.col(f"__t{i}") + F.lit(TABLE_ROWS))) for i in range(len(languages))]
    )
    return summed.crossJoin(F.broadcast(per_language)).select(*keys, shares.alias(out))  # one row


def identify(
    docs: DataFrame,
    text: str,
    languages: Sequence[str],
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    train_rows: int = TRAIN_ROWS,
    min_posterior: float = MIN_POSTERIOR,
) -> DataFrame:
    """All columns of ``docs`` with __lang, __posterior and __accepted.

    __lang is the likeliest language, __posterior its probability after all
    evidence, and __accepted says that the text has letters, is like the declared
    texts of one of the languages at all, and the probability reaches
    ``min_posterior``.  Null evidence says nothing; a null, empty or
    letterless text is judged by the rest and not accepted.  Ties go to the
    earlier language.  Declared values outside ``languages`` are kept as
    evidence but not learned from, and the text must then fit better to be
    accepted.  Without any declared row the text says nothing.  Rows are neither merged nor lost; an empty table gives no rows.

    The corpus is read for the sample, once for the counts and once for the
    result; texts are not shuffled unless the host table is too large to send.
    """
    n = len(languages)
    none = F.lit(None).cast("string")
    rows = docs.withColumns(
        {
            "__text": F.col(f"`{text}`"),
            "__declared": none if declared is None else declared,
            "__host": none if host is None else host,
            "__suffix": none if suffix is None else suffix,
        }
    )
    halves = _bucket_counts(rows, languages, train_rows)
    model = text_model(halves.sum(axis=0))
    usual = usual_fit(halves)
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # languages x buckets, fixed size

    @F.arrow_udf("array<double>")
    def evidence(raw: pa.Array) -> pa.Array:
        weights = shared.value.astype(float)  # one text at a time leaves the batch, so no second copy of it is held
        return pa.array([text_evidence(weights, t.as_py(), *usual) for t in raw], pa.list_(pa.float64()))

    scored = rows.withColumn("__ll", evidence(F.col("__text").cast("binary")))

    # --- what the corpus says, as sums of text posteriors -------------------
    sharp = F.transform(F.slice("__ll", 1, n), lambda x: F.exp(x))
    posterior = F.transform(sharp, lambda x: x / F.aggregate(sharp, F.lit(0.0), lambda a, b: a + b))
    seen = (
        scored.select("__declared", "__suffix", "__host", "__ll")
        .where(F.col("__ll").isNotNull())
        .withColumn("__p", posterior)
        .groupBy("__declared", "__suffix", "__host")
        .agg(*[F.sum(F.col("__p")[i]).alias(f"__n{i}") for i in range(n)])
        .select("__declared", "__suffix", "__host", F.array(*[F.col(f"__n{i}") for i in range(n)]).alias("__n"))
    )
    seen = materialize(seen.withColumn("__parent", parent_host(F.col("__host"))), "languages")

    totals = seen.agg(*[F.coalesce(F.sum(F.col("__n")[i]), F.lit(0.0)).alias(f"__a{i}") for i in range(n)]).first()
    overall = sum(totals) + TABLE_ROWS
    everywhere = [(x + TABLE_ROWS / n) / overall for x in totals]

    def counted(keys: list[str]) -> DataFrame:
        return seen.groupBy(*keys).agg(*[F.sum(F.col("__n")[i]).alias(f"__c{i}") for i in range(n)])

    def smoothed(prior: list[Column]) -> Column:
        size = sum((F.col(f"__c{i}") for i in range(n)), F.lit(0.0))
        return F.array(*[(F.col(f"__c{i}") + HOST_ROWS * p) / (size + HOST_ROWS) for i, p in enumerate(prior)])

    # The only host of a parent that is the host itself has one level above it, so that its rows count once.
    alone = (F.col("__parent") == F.min("__host")) & (F.min("__host") == F.max("__host"))
    sums = [F.sum(F.col("__n")[i]).alias(f"__c{i}") for i in range(n)]
    parents = seen.groupBy("__parent").agg(*sums, alone.alias("__alone")).select(
        "__alone", F.col("__parent").alias("__up"), smoothed([F.lit(float(p)) for p in everywhere]).alias("__prior_up")
    )
    hosts = (
        counted(["__host", "__parent"])
        .where(F.col("__host").isNotNull())
        .join(parents, F.col("__parent") == F.col("__up"))
        .select(
            F.col("__host").alias("__h"),
            F.when(F.col("__alone"), F.col("__prior_up"))
            .otherwise(smoothed([F.col("__prior_up")[i] for i in range(n)]))
            .alias("__prior"),
        )
    )
    by_declared = _shares(seen.where("__declared IS NOT NULL"), ["__declared"], languages, "__of_declared")
    by_suffix = _shares(seen.where("__suffix IS NOT NULL"), ["__suffix"], languages, "__of_suffix")

    joined = (
        scored.join(materialize(hosts, "hosts"), F.col("__host") == F.col("__h"), "left")
        .join(
            materialize(by_declared.withColumnRenamed("__declared", "__d"), "declared"),
            F.col("__declared") == F.col("__d"),
            "left",
        )
        .join(
            materialize(by_suffix.withColumnRenamed("__suffix", "__s"), "suffixes"),
            F.col("__suffix") == F.col("__s"),
            "left",
        )
    )
    parts = []
    for i in range(n):
        prior = F.log(F.coalesce(F.col("__prior")[i], F.lit(float(everywhere[i]))))
        rest = [F.coalesce(F.col(c)[i], F.lit(0.0)) for c in ("__ll", "__of_declared", "__of_suffix")]
        parts.append(prior + rest[0] + rest[1] + rest[2])
    fused = joined.withColumn("__log", F.array(*parts))
    best = F.array_max("__log")
    weight = F.aggregate("__log", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    at = F.array_position("__log", best)
    names = F.array(*[F.lit(x) for x in languages])
    # The first part of a tag such as en-GB names the language.
    foreign = ~F.regexp_extract(F.lower("__declared"), r"\A([^_-]*)", 1).isin([x.lower() for x in languages])
    margin = F.when(foreign, F.col("__ll")[n + 1]).otherwise(F.col("__ll")[n])
    return fused.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.get(names, (at - 1).cast("int")).alias("__lang"),
        (F.lit(1.0) / weight).alias("__posterior"),
        (F.col("__ll").isNotNull() & (margin >= 0) & (F.lit(1.0) / weight >= min_posterior)).alias("__accepted"),
    )
