"""Spelling variants: words one edit apart, found through pivotal grams.

All bigrams have one order, the rarest in the word list first.  The prefix of a
word is its three rarest bigrams; two of them that do not overlap are its pivots,
those with the smallest sum of frequencies (dynamic programming).  One edit
spoils at most one of two pivots, so of two words one edit apart, the one whose
prefix ends earlier in the order has a pivot that stands unspoilt in the other
word, inside the other's prefix.

The edit lies wholly before or wholly behind that pivot, so both words are equal
from the beginning to the end of the bigram or from the bigram to the end, and the
places of the bigram differ by at most one.  What lies on the other side of the
bigram is cut in the middle: the edit leaves one half of it alone, too.  These
stretches, counted from both ends, are the position limits of the index: words
meet only if a pivot, all that lies on one side of it and half of what lies on
the other are the same.  Candidates are verified by edit distance.

The list of words is never in one place: pivots and prefixes are rows of a join.
Only the frequencies of bigrams go to every task, at most 90 * 90 of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import SLICE_ROWS
from textloom.session import materialize

#: Letters of a run once A-Z are lower-cased; there are 26 + 64 of them, which bounds the bigrams.
LETTERS = "a-zÀ-ÿ"
#: Code points of a word, its least occurrences; a form occurs so many times as often.
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
#: Edits between variants, code points of a gram; one edit spoils at most GRAM grams.
EDITS, GRAM = 1, 2
#: One run in so many loses a code point.
NOISE = 31


def noisy(run: str, start: int, noise: int) -> str:
    """The run, or the run without one code point if ``noise`` divides its checksum; ``start``: crc32 before it."""
    checksum = zlib.crc32(run.encode(), start)
    if checksum % noise:
        return run
    at = checksum % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int | None = NOISE, least: int = LEAST_LENGTH
) -> DataFrame:
    """word, n: words of at least ``least`` code points of whole texts and how often they occur.

    A run of letters is lower-cased (A-Z only); if ``noise`` is given, one run in
    so many, by the checksum of ``key:run``, loses a code point.  A null key counts
    as the empty string, a null text has no runs.
    """
    # Maximal: a shorter run is never part of a match, and a match takes all letters it can.
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(first, SLICE_ROWS)
                total: Counter = Counter()
                for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    # bytes.lower() changes A-Z only.
                    found = Counter(runs.findall((raw.as_py() or b"").lower().decode("utf-8", "replace")))
                    if noise is None:
                        total.update(found)
                        continue
                    start = zlib.crc32(f"{name}:".encode())
                    for run, n in found.items():
                        word = noisy(run, start, noise)
                        if len(word) >= least:
                            total[word] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
                )

    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    source = docs.select(name.alias("__id"), F.col(f"`{text}`").cast("binary").alias("__text"))
    # Combined before the shuffle: a word that makes a third of all runs is one row per task.
    return source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def choose_pivots(places: Sequence[int], costs: Sequence[int], count: int, gram: int) -> list[int]:
    """Indexes of ``count`` places, ascending and at least ``gram`` apart, with the smallest sum of costs.

    best[k][i] is the cheapest choice of k places among the first i.  Ties go to earlier places.
    """
    none = (float("inf"), ())
    before = []
    at = 0
    for i, place in enumerate(places):
        while places[at] <= place - gram:
            at += 1
        before.append(at)  # so many places end before this one begins
    best = [(0, ())] * (len(places) + 1)
    for _ in range(count):
        row = [none]
        for i, cost in enumerate(costs):
            head = best[before[i]]
            row.append(min(row[-1], (head[0] + cost, head[1] + (i,))))
        best = row
    return list(best[-1][1])


def gram_frequencies(words: DataFrame) -> dict[str, int]:
    """Occurrences of every bigram in the list of words; at most 90 * 90 entries, by the letters that a run may hold."""
    grams = F.transform(
        F.sequence(F.lit(1), F.length("word") - (GRAM - 1)), lambda i: F.substring(F.col("word"), i, F.lit(GRAM))
    )
    rows = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {row["gram"]: row["n"] for row in rows}


def limits(place: int, length: int, shorter: int) -> Iterator[tuple[int, int]]:
    """How many code points from the beginning and from the end are equal, for each half in which an edit may lie.

    The gram at ``place`` is not touched by the edit, ``shorter`` is the length of the shorter word.
    """
    head = place + GRAM
    if head <= shorter:  # the edit lies behind the gram
        half = (shorter - head) // 2
        yield head + half, 0
        yield head, shorter - head - half
    tail = length - place
    if tail <= shorter:  # the edit lies before the gram
        half = (shorter - tail) // 2
        yield half, tail
        yield 0, shorter - half


def stretches(words: DataFrame) -> DataFrame:
    """Rows word, n, last, key, longer, pivot: every stretch of a word that a variant may have in common with it.

    ``last`` is the position in the order of grams at which the prefix of the word
    ends; grams equal to the last one all belong to the prefix.  All rows form the
    index; those that come from a pivot search it.  ``longer`` says that the stretch
    supposes a variant that is shorter than the word.
    """
    frequency = gram_frequencies(words)
    rank = {gram: i for i, gram in enumerate(sorted(frequency, key=lambda g: (frequency[g], g)))}
    size = EDITS * GRAM + 1

    def keys_of(word: str) -> tuple[int, dict[tuple[int, bool], bool]]:
        length = len(word)
        grams = [word[i : i + GRAM] for i in range(length - GRAM + 1)]
        ranks = [rank[gram] for gram in grams]
        last = sorted(ranks)[size - 1]
        places = [i for i, r in enumerate(ranks) if r <= last]
        chosen = choose_pivots(places, [frequency[grams[p]] for p in places], EDITS + 1, GRAM)
        pivots = {places[i] for i in chosen}
        found: dict[tuple[int, bool], bool] = {}
        for place in places:
            for shorter in (length, length - EDITS):
                for front, back in limits(place, length, shorter):
                    stretch = f"{shorter}:{back}:{word[:front]}:{word[length - back :]}"
                    key = xxhash.xxh64_intdigest(stretch) - (1 << 63), shorter < length
                    found[key] = found.get(key, False) or place in pivots
        return last, found

    fields = {"word": pa.string(), "n": pa.int64(), "last": pa.int32(), "key": pa.int64(), "longer": pa.bool_(), "pivot": pa.bool_()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 4 * SLICE_ROWS):
                batch = whole.slice(first, 4 * SLICE_ROWS)
                out: dict[str, list] = {name: [] for name in fields}
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    last, found = keys_of(word)
                    for name, value in (("word", word), ("n", n), ("last", last)):
                        out[name] += [value] * len(found)
                    out["key"] += [key for key, _ in found]
                    out["longer"] += [longer for _, longer in found]
                    out["pivot"] += found.values()
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in fields.items()], names=list(fields))

    return words.select("word", "n").mapInArrow(
        cut, "word string, n long, last int, key long, longer boolean, pivot boolean"
    )


def near_words(words: DataFrame) -> DataFrame:
    """Rows a, na, b, nb, each pair once (a < b): distinct words (word, n) one edit apart.

    A stretch that very many words share is split by the skew handling of the
    join.  ``words`` is read several times.
    """
    rows = materialize(stretches(words), "stretches")
    ends = ("word", "n", "last", "longer")
    left = rows.where("pivot").select("key", *[F.col(c).alias(f"__l_{c}") for c in ends])
    right = rows.select("key", *[F.col(c).alias(f"__r_{c}") for c in ends])
    # Two words of one length meet on a stretch of that length.
    met = left.join(right, "key").where(
        "__l_last <= __r_last AND NOT (__l_longer AND __r_longer) AND __l_word <> __r_word"
    )
    close = met.where(F.levenshtein("__l_word", "__r_word", EDITS) == EDITS)
    one, other = (F.struct(F.col(f"__{c}_word").alias("word"), F.col(f"__{c}_n").alias("n")) for c in "lr")
    pairs = close.select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y")).distinct()
    return pairs.select(
        F.col("x.word").alias("a"), F.col("x.n").alias("na"), F.col("y.word").alias("b"), F.col("y.n").alias("nb")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word and root for every row of ``forms`` (word, form), following forms to the last.

    Every step to a form multiplies the count, so chains end.  Each round doubles
    the steps and is written, until no root has a form.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        joined = now.join(step, "root", "left")
        moved = materialize(
            joined.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")), "roots"
        )
        if moved.where("__moved").isEmpty():
            return now
        now = moved.drop("__moved")


def spelling_variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    noise: int | None = None,
    factor: int = FORM_FACTOR,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus.

    Words are runs of Latin letters of at least ``LEAST_LENGTH`` code points that
    occur ``least_count`` times.  The form of a word is the most frequent word one
    edit away (ties: the smallest), if it occurs ``factor`` times as often; the
    root is the last of the chain of forms, the word itself without one.  Null and
    empty texts have no words; an empty table, or one without words, gives no
    rows.  Repeated rows and rows of one id count each.  Other columns are not
    looked at, whatever their names.
    """
    counted = word_counts(docs, key, text, noise).where(F.col("n") >= least_count)
    words = materialize(counted, "words")
    pairs = materialize(near_words(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    # Smallest first, so that the largest count and, among equals, the smallest word wins.
    best = F.min(F.struct((-F.col("nb")).alias("__less"), F.col("b").alias("form")))
    found = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("__best"))
    enough = -F.col("__best.__less") >= factor * F.col("n")
    judged = words.join(found, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("__best.form")).alias("form"),
        F.when(enough, -F.col("__best.__less")).alias("form_n"),
    )
    judged = materialize(judged, "variants")
    chains = roots(judged.where("form IS NOT NULL"))
    return judged.join(chains, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
