"""Removal of passages that repeat across documents, in content-defined chunks of lines.

Each line has a hash.  A rolling hash over the last ``SPAN`` line hashes
decides whether a chunk ends after a line, so boundaries depend on nearby lines
only: after an insertion, or in another document, the same lines are cut in the
same places.  A line of ``LONG_WORDS`` words or more is a paragraph and a chunk
of its own.  Chunks of several lines, and such paragraphs, that occur again
anywhere are removed, but for the first occurrence; what is equal is decided by
the bytes.

``remove_passages`` does without chunks: every two neighbouring lines are
compared, so a passage goes from its first to its last line, however short its
lines are and whatever stands around it.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import WORD, text_hash
from textloom.session import materialize

#: Lines in the rolling hash; one boundary in so many lines; multiplier of the rolling hash.
SPAN, DIVISOR, BASE = 2, 3, 31
#: A chunk of several lines has at least so many characters; a line is long from so many words.
LEAST_CHARS, LONG_WORDS = 40, 50

# Marks in front of every line while a text is being cut.  Lines hold no line
# feed, so a line feed with one letter can only be a mark.
_BEGIN, _CONTINUE = "\nB", "\nC"


def line_hash(line: Column) -> Column:
    """The first 28 bits of the md5 of a line, -1 for a long line."""
    digits = F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("bigint")
    long_line = (F.length(line) >= 2 * LONG_WORDS - 1) & (F.regexp_count(line, F.lit(WORD)) >= LONG_WORDS)
    return F.when(long_line, F.lit(-1).cast("bigint")).otherwise(digits)


def _begins(hashes: Column, i: Column) -> Column:
    """Whether a chunk begins at line i: the first line, at and after a long line, or by the rolling hash before it."""
    total = F.lit(0).cast("bigint")
    for back in range(SPAN):
        at = i - 1 - back
        total = total + F.when(at >= 0, F.get(hashes, at)).otherwise(0) * (BASE**back)
    return (i == 0) | (F.get(hashes, i) == -1) | (F.get(hashes, i - 1) == -1) | (F.pmod(total, F.lit(DIVISOR)) == 0)


def with_pieces(docs: DataFrame, text: str, out: str = "__pieces") -> DataFrame:
    """Add the chunks of a text; the lines of a chunk are joined by the mark of continuation."""
    body = F.col(f"`{text}`")
    lines = docs.withColumn("__lines", F.split(body, "\n", -1))
    hashed = lines.withColumn("__hashes", F.transform("__lines", line_hash))
    marked = F.transform(
        "__lines",
        lambda line, i: F.concat(F.when(_begins(F.col("__hashes"), i), _BEGIN).otherwise(_CONTINUE), line),
    )
    pieces = F.split(F.substring(F.array_join(marked, ""), 3, 2**31 - 1), _BEGIN, -1)
    return hashed.withColumn(out, pieces).drop("__lines", "__hashes")


def removable(piece: Column) -> Column:
    several = F.contains(piece, F.lit(_CONTINUE)) & (F.length(piece) >= LEAST_CHARS)
    one = (F.length(piece) >= 2 * LONG_WORDS - 1) & (F.regexp_count(piece, F.lit(WORD)) >= LONG_WORDS)
    return several | (~F.contains(piece, F.lit(_CONTINUE)) & one)


def _repeats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document (__id, __hash) the sorted positions of chunks that occurred before."""
    cut = with_pieces(docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text")), "__text")
    # Judged inside the array, so that only removable chunks become rows.
    able = F.filter(
        F.transform("__pieces", lambda piece, at: F.struct(at.alias("__at"), piece.alias("__piece"))),
        lambda x: removable(x["__piece"]),
    )
    rows = cut.select("__id", text_hash(F.col("__text")).alias("__hash"), F.inline(able))
    rows = rows.withColumn("__key", F.xxhash64("__piece"))
    place = F.struct(F.col("__id").isNull().alias("last"), "__id", "__hash", "__at")
    # Grouped by the bytes, combined before the shuffle: a passage of a third of
    # all documents is one row per task.
    by_bytes = rows.groupBy("__key", "__piece").agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
    # A hash that stands for several different chunks proves nothing and is left alone.
    repeated = (
        by_bytes.groupBy("__key")
        .agg(F.count("*").alias("__texts"), F.sum("__n").alias("__n"), F.min("__first").alias("__first"))
        .where("__texts = 1 AND __n > 1")
        .select("__key", "__first")
    )
    narrow = materialize(rows.select("__id", "__hash", "__at", "__key", place.alias("__place")), "chunks")
    again = narrow.join(repeated, "__key").where(F.col("__place") != F.col("__first"))
    # Bounded by the chunks of one document.
    return again.groupBy("__id", "__hash").agg(F.sort_array(F.collect_set("__at")).alias("__again"))


def _flags(again: str, pieces: str) -> Column:
    """'1' for a piece that stays, '0' for one that goes, one character each, from the sorted places of the latter."""
    gap = F.transform(
        again,
        lambda at, k: F.concat(
            F.repeat(F.lit("1"), at - F.when(k == 0, F.lit(0)).otherwise(F.get(again, k - 1) + 1)), F.lit("0")
        ),
    )
    return F.split(F.rpad(F.array_join(gap, ""), F.size(pieces), "1"), "")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without repeated chunks, and __n_chunks, __n_removed.

    The first occurrence, by id (null last) and place in the text, stays.  A
    text of which every chunk is removed becomes empty; null texts stay null
    with 0 chunks, an empty text is one chunk that stays.  Rows that agree in
    id and text count as one document: all get the same result.  Rows with a
    null id are told apart by their text.  Line ends are not changed.  An empty
    table gives no rows; other columns are handed through whatever their names,
    unless they start with two underscores.
    """
    names = docs.columns
    body = F.col(f"`{text}`")
    again = _repeats(docs, key, text).select(F.col("__id").alias("__i"), F.col("__hash").alias("__h"), "__again")
    joined = docs.withColumn("__hash", text_hash(body)).join(
        again, F.col(f"`{key}`").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left"
    )
    cut = with_pieces(joined, text)
    flags = _flags("__again", "__pieces")
    # Zipped, not looked up inside a lambda: the flags are then made once per text.
    kept = F.zip_with(
        "__pieces", flags, lambda piece, flag: F.when(flag == "1", F.replace(piece, F.lit(_CONTINUE), F.lit("\n")))
    )
    rebuilt = F.array_join(kept, "\n")
    new_text = F.when(F.col("__again").isNull(), body).otherwise(rebuilt)
    return cut.select(
        *[new_text.alias(c) if c == text else F.col(f"`{c}`") for c in names],
        F.coalesce(F.size("__pieces"), F.lit(0)).cast("bigint").alias("__n_chunks"),
        F.coalesce(F.size("__again"), F.lit(0)).cast("bigint").alias("__n_removed"),
    )


def _line_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document (__id, __hash) its pairs of neighbouring lines and its long lines: first and last line, digest."""
    lines = F.filter(
        F.transform(F.split(F.col(f"`{text}`"), "\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
        lambda x: x["line"].rlike(WORD),
    )
    rows = docs.select(
        F.col(f"`{key}`").alias("__id"), text_hash(F.col(f"`{text}`")).alias("__hash"), lines.alias("__lines")
    )

    def unit(first: Column, last: Column, piece: Column) -> Column:
        digest = F.unhex(F.sha2(piece.cast("binary"), 256))
        return F.struct(first.alias("__at"), last.alias("__to"), digest.alias("__key"))

    # Line by line with the one after; the last line has none.
    after = F.slice("__lines", F.lit(2), F.size("__lines"))
    pairs = F.zip_with(
        "__lines", after, lambda x, y: F.when(y.isNotNull(), unit(x["i"], y["i"], F.concat_ws("\n", x["line"], y["line"])))
    )
    long_lines = F.transform(
        F.filter("__lines", lambda x: (F.length(x["line"]) >= 2 * LONG_WORDS - 1) & (F.regexp_count(x["line"], F.lit(WORD)) >= LONG_WORDS)),
        lambda x: unit(x["i"], x["i"], x["line"]),
    )
    return rows.select("__id", "__hash", F.inline(F.filter(F.concat(pairs, long_lines), lambda x: x.isNotNull())))


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without repeated passages, and __n_lines, __n_removed.

    A passage is two or more neighbouring lines with words, blank lines between
    them left out of account, or one line of ``LONG_WORDS`` words.  Whatever was
    there before, by id (null last), text and place, goes with the blank lines
    inside it; of a pair that overlaps its own first occurrence only the second
    line.  Every line that goes is still there at an earlier place.  Lines are
    compared by their SHA-256.  Rows that agree in id and text count as one
    document; null texts stay null with 0 lines.  Rows are neither merged nor lost.
    """
    body = F.col(f"`{text}`")
    place = F.struct(F.col("__id").isNull().alias("last"), "__id", "__hash", "__at")
    units = materialize(_line_pairs(docs, key, text), "line-pairs")
    # Combined before the shuffle: a passage of a third of all documents is one row per task.
    repeated = (
        units.groupBy("__key")
        .agg(F.count("*").alias("__n"), F.min(F.struct(place.alias("place"), F.col("__to").alias("to"))).alias("__first"))
        .where("__n > 1")
        .select("__key", F.col("__first.place").alias("__first"), F.col("__first.to").alias("__first_to"))
    )
    again = units.withColumn("__place", place).join(repeated, "__key").where(F.col("__place") != F.col("__first"))
    overlaps = (
        F.col("__id").eqNullSafe(F.col("__first.__id"))
        & (F.col("__hash") == F.col("__first.__hash"))
        & (F.col("__at") == F.col("__first_to"))
    )
    gone = again.select(
        F.col("__id").alias("__i"),
        F.col("__hash").alias("__h"),
        F.explode(F.sequence(F.col("__at") + overlaps.cast("int"), "__to")).alias("__line"),
    )
    # Bounded by the lines of one document.
    gone = gone.groupBy("__i", "__h").agg(F.sort_array(F.collect_set("__line")).alias("__again"))
    cut = (
        docs.withColumn("__hash", text_hash(body))
        .join(gone, F.col(f"`{key}`").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")
        .withColumn("__lines", F.split(body, "\n", -1))
    )
    kept = F.zip_with("__lines", _flags("__again", "__lines"), lambda line, flag: F.when(flag == "1", line))
    new_text = F.when(F.col("__again").isNull(), body).otherwise(F.array_join(kept, "\n"))
    return cut.select(
        *[new_text.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint").alias("__n_lines"),
        F.coalesce(F.size("__again"), F.lit(0)).cast("bigint").alias("__n_removed"),
    )
