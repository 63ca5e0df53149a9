"""Token windows, chunks and sentence spans.

A document is one row, so its token array bounds every list built here;
windows and spans are derived from that row, not from joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from textloom.functions.text import sentence_sizes, split_whitespace
from textloom.functions.tokens import token_count, token_list
from textloom.operators.ranking import seeded_hash


def _indices(count: Column) -> Column:
    """0 .. count - 1, empty when the count is 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count)


def sliding_token_windows(
    df: DataFrame, tokens: str, length: int, stride: int | None = None, truncate: int | None = None
) -> DataFrame:
    """One row per window of ``length`` tokens, moved by ``stride`` (a quarter
    by default).  Only the first window counts from its start; later ones carry
    ``length - stride`` tokens of context.  ``truncate`` bounds the covered
    tokens; the default covers the whole text.
    """
    stride = stride or length // 4
    n = F.size(tokens)
    windows = F.greatest(F.ceil((n - length) / stride).cast("int") + 1, F.lit(1))
    if truncate is not None:
        windows = F.least(windows, F.lit((truncate - length + stride) // stride))
    rest = [c for c in df.columns if c != tokens]
    # The slices are cut inside the row, so the rows that come out do not each
    # carry the whole token list.
    entries = F.transform(
        _indices(windows),
        lambda i: F.struct(
            i.alias("window_no"),
            F.slice(tokens, i * stride + 1, length).alias("input_ids"),
            (i * stride).alias("prefix_token_offset"),
        ),
    )
    cut = df.select(*rest, F.inline(entries))
    first = F.col("window_no") == 0
    context = max(0, length - stride)
    return cut.withColumns(
        {
            "start_token_idx": F.when(first, 0).otherwise(context),
            "window_size": F.when(first, F.size("input_ids")).otherwise(
                F.size("input_ids") - (length - stride)
            ),
        }
    )


def reassemble_windows(df: DataFrame, key: str) -> DataFrame:
    """Inverse of the windows: drop each context, order by offset, concatenate."""
    own = F.expr("slice(input_ids, start_token_idx + 1, greatest(size(input_ids) - start_token_idx, 0))")
    # Cut before the grouping: else rows that are sorted or spilled there carry every context.
    cut = df.select(key, "prefix_token_offset", own.alias("own"))
    pieces = F.sort_array(F.collect_list(F.struct("prefix_token_offset", "own")))
    return cut.groupBy(key).agg(pieces.alias("p")).select(
        key, F.flatten(F.col("p.own")).alias("tokens")
    )


@F.pandas_udf(ArrayType(IntegerType()))
def _prefix_starts(sizes: pd.Series, limit: pd.Series) -> pd.Series:
    """For every chunk the first chunk of the longest run that ends with it and
    fits the limit (itself when it alone is too long)."""

    def starts(lengths: np.ndarray, bound: int) -> np.ndarray:
        after = np.cumsum(lengths)
        found = np.searchsorted(after - lengths, after - bound, side="left")
        return np.minimum(found, np.arange(len(lengths))).astype("int32")

    return pd.Series(
        [starts(np.asarray(s, dtype="int64"), b) for s, b in zip(sizes, limit)], dtype="object"
    )


def rolling_prefix_windows(df: DataFrame, key: str, chunks: str, length: int) -> DataFrame:
    """One row per non-blank chunk with as many preceding chunks as fit
    ``length`` tokens; a longer chunk is truncated."""
    sized = df.select(
        key, chunks, F.transform(chunks, lambda c: F.size(token_list(c))).alias("sizes")
    )
    started = sized.withColumn("starts", _prefix_starts("sizes", F.lit(length)))

    def window(first: Column, own: Column) -> Column:
        in_prefix = F.aggregate(
            F.slice("sizes", first + 1, own - first), F.lit(0), lambda a, x: a + x
        )
        return F.struct(
            first.alias("prefix_chunk_idx"),
            own.alias("start_chunk_idx"),
            (own + 1).alias("end_chunk_idx"),
            in_prefix.alias("start_token_idx"),
            F.least(in_prefix + F.get("sizes", own), F.lit(length)).alias("length"),
            (F.size(split_whitespace(F.get(chunks, own))) == 0).alias("blank"),
        )

    rows = started.select(key, F.inline(F.transform("starts", window)))
    return rows.where("NOT blank").drop("blank")


def fixed_chunks(
    tokens: Column,
    length: int,
    stride: int | None = None,
    min_tail: int = 1,
    max_chunks: int | None = None,
) -> Column:
    """Consecutive chunks; with a stride they may overlap, and the first chunk
    shorter than ``min_tail`` ends the list."""
    stride = stride or length
    count = F.ceil(F.size(tokens) / stride).cast("int")
    if min_tail > 1:
        usable = F.floor((F.size(tokens) - min_tail) / stride).cast("int") + 1
        count = F.least(count, F.greatest(usable, F.lit(0)))
    if max_chunks is not None:
        count = F.least(count, F.lit(max_chunks))
    return F.transform(_indices(count), lambda i: F.slice(tokens, i * stride + 1, length))


def sentence_token_spans(
    docs: DataFrame, key: str, feature_len: Column | None = None, text: str = "text", min_length: int = -1
) -> DataFrame:
    """(key, span_no, start, end): token range of every sentence, cut at
    ``feature_len``; sentences that start beyond it are gone.  Without one it
    is the number of tokens of the text."""
    # Both are fixed before the rows multiply: next to a generator an expression
    # would be evaluated for every sentence.
    sized = docs.withColumn("sizes", sentence_sizes(F.col(text), token_count))
    if feature_len is None:  # a sentence neither ends nor is trimmed inside a token
        feature_len = F.aggregate("sizes", F.lit(0), lambda total, n: total + n)
    sized = sized.select(key, feature_len.alias("feature_len"), "sizes")
    # Not plain posexplode: for it the sizes are worked out once more, to drop rows without any.
    counted = sized.select(key, "feature_len", F.posexplode_outer("sizes").alias("sent_no", "n")).where("sent_no IS NOT NULL")
    before = Window.partitionBy(key).orderBy("sent_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))
    spans = placed.where("start < feature_len").select(
        key,
        "sent_no",
        "start",
        F.least(F.col("start") + F.col("n"), F.col("feature_len")).cast("int").alias("end"),
    )
    kept = spans.where(F.col("end") - F.col("start") > min_length)
    number = F.row_number().over(Window.partitionBy(key).orderBy("sent_no")) - 1
    return kept.select(key, number.alias("span_no"), "start", "end")


def stack_neighbour_spans(spans: DataFrame, key: str, k: int) -> DataFrame:
    """Extend each span to the start of the k-th before and the end of the
    k-th after, where they exist."""
    order = Window.partitionBy(key).orderBy("span_no")
    return spans.select(
        key,
        "span_no",
        F.coalesce(F.lag("start", k).over(order), "start").alias("start"),
        F.coalesce(F.lead("end", k).over(order), "end").alias("end"),
    )


def plan_chunk_replacement(df: DataFrame, chunks: str, seed: Column, n_words: int = 2000) -> DataFrame:
    """Pick a block of 1 .. n/2 consecutive chunks from a content seed.

    Texts of fewer than four chunks get none.  Both contexts leave out the
    chunk next to the block, and hold at most ``n_words`` words.
    """
    n = F.size(chunks)

    def below(name: str, bound: Column) -> Column:
        number = F.conv(F.substring(seeded_hash(name, seed), 1, 12), 16, 10).cast("bigint")
        return F.pmod(number, bound).cast("int")

    planned = df.where(n >= 4).withColumn("total_chunks", n)
    planned = planned.withColumn(
        "n_replaced", below("amount", F.floor(F.col("total_chunks") / 2)) + 1
    )
    planned = planned.withColumn(
        "start_idx", below("start", F.col("total_chunks") - F.col("n_replaced") + 1)
    ).withColumn("end_idx", F.col("start_idx") + F.col("n_replaced"))
    start, end, total = F.col("start_idx"), F.col("end_idx"), F.col("total_chunks")

    def word_list(pieces: Column) -> Column:
        return split_whitespace(F.array_join(pieces, ""))

    before = word_list(F.slice(chunks, 1, F.greatest(start - 1, F.lit(0))))
    after = word_list(F.slice(chunks, end + 2, F.greatest(total - end - 1, F.lit(0))))
    return planned.withColumns(
        {
            "percent": F.round(100 / total * F.col("n_replaced"), 2),
            "before": F.array_join(
                F.slice(before, F.greatest(F.size(before) - n_words + 1, F.lit(1)), n_words), " "
            ),
            "replaced": F.array_join(F.slice(chunks, start + 1, F.col("n_replaced")), " "),
            "after": F.array_join(F.slice(after, 1, n_words), " "),
        }
    )
