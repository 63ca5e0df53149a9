"""Word tokens with character offsets and vocabulary ids."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from textloom.functions.patterns import TOKEN
from textloom.operators.ranking import salted_lookup, with_rank

#: Text that Python takes apart at a time.
SLICE_BYTES = 1024 * 1024

_TOKEN = regex.compile(TOKEN)
_FOUND = StructType(
    [
        StructField("start", ArrayType(IntegerType())),
        StructField("end", ArrayType(IntegerType())),
        StructField("token", ArrayType(StringType())),
    ]
)
_PLACED = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def token_list(text: Column) -> Column:
    """Lower-cased word tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def token_count(text: Column) -> Column:
    """Number of word tokens, without making the list."""
    return F.regexp_count(text, F.lit(TOKEN))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of about ``SLICE_BYTES`` of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype="int64") // SLICE_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    yield from (texts.slice(a, b - a) for a, b in zip(bounds, bounds[1:]))


@functools.cache
def _in_token() -> np.ndarray:
    """For every code point, and one beyond, whether tokens are made of it; made once per Python worker."""
    member = np.zeros(sys.maxunicode + 2, dtype=bool)
    for low in range(0, sys.maxunicode + 1, 1 << 16):
        for found in _TOKEN.finditer("".join(map(chr, range(low, low + (1 << 16))))):
            member[low + found.start() : low + found.end()] = True
    return member


def _found(texts: pa.Array, words: bool) -> pa.Array:
    """Tokens of all texts at once: a token is a maximal run of code points that belong to tokens.

    Lists side by side with the words, a list of places without."""
    listed = [text or "" for text in texts.to_pylist()]
    # A line break, which belongs to no token, stands before each text and after the last.
    codes = np.frombuffer("\n".join(["", *listed, ""]).encode("utf-32-le"), dtype="<u4")
    bounds = np.flatnonzero(np.diff(_in_token()[codes])) + 1
    first, last = bounds[::2], bounds[1::2]
    begins = np.cumsum([1, *[len(text) + 1 for text in listed]])
    counts = np.searchsorted(first, begins)
    shift = np.repeat(begins[:-1], np.diff(counts))
    offsets = pa.array(counts.astype("int32"))
    starts, ends = (first - shift).astype("int32"), (last - shift).astype("int32")
    parts = {"start": pa.array(starts), "end": pa.array(ends)}
    if not words:
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(parts.values()), names=list(parts)))
    spans = zip(np.split(starts, counts[1:-1]), np.split(ends, counts[1:-1]))
    tokens = [t[i:j] for t, (a, b) in zip(listed, spans) for i, j in zip(a.tolist(), b.tolist())]
    parts["token"] = pa.array(tokens, type=pa.string())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, p) for p in parts.values()], names=list(parts))


def _in_slices(batches: Iterator[pa.Array], words: bool) -> Iterator[pa.Array]:
    """What Python holds at a time are the matches of one slice, however many rows a batch has."""
    for texts in batches:
        for part in _slices(texts):
            yield _found(part, words)
    pa.default_memory_pool().release_unused()  # the worker lives on for other tasks


@F.arrow_udf(_FOUND)
def _found_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _in_slices(batches, True)


@F.arrow_udf(_PLACED)
def _token_places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _in_slices(batches, False)


def with_token_offsets(docs: DataFrame, text: str = "text", out: str = "offsets") -> DataFrame:
    """Add the half-open character range of every token as an array of
    (start, end); Spark's regular expression functions return no positions.
    A NULL text has no tokens."""
    return docs.withColumn(out, _token_places(F.col(text)))


def token_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, token) rows."""
    return docs.select(key, F.posexplode(token_list(F.col(text))).alias("pos", "token"))


def offset_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, start, end, token) rows; ``substring(text)`` at the offsets is the token."""
    placed = docs.select(key, _found_tokens(F.col(text)).alias("p"))
    rows = placed.select(
        key,
        F.posexplode(
            F.arrays_zip(
                F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.token").alias("token")
            )
        ).alias("pos", "t"),
    )
    return rows.select(key, "pos", "t.start", "t.end", "t.token")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(token, n, token_id): ids count up from the most frequent token."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return with_rank(counts, [F.desc("n"), F.col("token")], out="token_id")


def encode_tokens(tokens: DataFrame, vocab: DataFrame, spread: str = "doc_id") -> DataFrame:
    """Attach ids; very frequent tokens are spread over several join tasks."""
    return salted_lookup(tokens, vocab, ["token"], weight="n", spread=[spread, "pos"]).drop("n")
