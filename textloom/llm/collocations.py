"""Frequent phrases by set-oriented mining (SETM) and their collocation scores.

The relation R_k holds every occurrence of a phrase of k words, sorted by piece
and position.  R_1 is cut from the texts and written once.  From R_k to R_k+1:

1. R_k is merge-joined with itself on piece and next position, and the groups of
   the result are counted over all rows;
2. occurrences of groups that are not frequent leave (semi-join), and what is left
   is written as R_k+1.

R_k is stored in blocks of many pieces of one language, its columns packed.  A piece
never spans blocks, so the merge join needs no shuffle, and the counts of a block
are combined before they are shuffled.  Positions leave a gap between pieces, so
that next positions are always of one piece.

The semi-join asks a bitmap of frequent groups of bounded size.  It may let others
through, which costs time; the counts after it decide, so nothing is lost and
nothing is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm.common import release_memory
from textloom.session import materialize

#: Words of a phrase, its least occurrences, phrases returned per language.
LONGEST, LEAST, BEST = 3, 10, 2000
#: A phrase goes if a longer one that holds it has so many percent of its occurrences.
COVERED = 50
#: Positions that a task holds before it writes its blocks, about; a longer piece is a block of its own.
BLOCK = 1 << 18
#: Bits of the bitmap of frequent groups (8 MB).
BITS = 1 << 26

#: What ends a piece, and the language of rows without one.
ENDS, NO_LANGUAGE = b".,;:!?\n\x0b\x0c\r", "und"

#: All ends become one mark, which no word can contain.
_TO_MARK = bytes.maketrans(ENDS, b"." * len(ENDS))
_BLOCK_FIELDS = "lang string, steps binary, groups binary, phrases binary"
_GROUP_FIELDS = "lang string, phrase string, n long"


def _narrow(values: np.ndarray) -> bytes:
    """The values in as few bytes each as the largest needs, behind one byte that tells how many."""
    size = np.min_scalar_type(int(values.max(initial=0))).itemsize
    return bytes([size]) + values.astype(f"u{size}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1)


def _packed(lang: str, places: np.ndarray, groups: np.ndarray, phrases: list[bytes]) -> pa.RecordBatch:
    """A block as one row; places ascend, groups number the phrases."""
    columns = (_narrow(np.diff(places, prepend=0)), _narrow(groups), b"\n".join(phrases))
    arrays = [pa.array([lang], pa.string()), *[pa.array([x], pa.binary()) for x in columns]]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "steps", "groups", "phrases"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[bytes]]]:
    for batch in batches:
        for row in range(batch.num_rows):
            lang, steps, groups, phrases = (batch.column(c)[row].as_py() for c in range(4))
            yield lang, np.cumsum(_wide(steps), dtype=np.int64), _wide(groups), phrases.split(b"\n")
        del batch
    release_memory()


def _counted(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.repeat(pa.scalar(lang, pa.string()), len(phrases)), phrases, pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])


class _Block:
    """Words of one language, in order, coded by a dictionary of the block; -1 ends a piece."""

    def __init__(self):
        self.codes: dict[bytes, int] = {b".": -1}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list[bytes]) -> None:
        codes = self.codes
        found = [codes.setdefault(token, len(codes) - 1) for token in tokens]
        self.parts.append(np.array(found + [-1], np.int32))
        self.size += len(found) + 1

    def packed(self, lang: str) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(self.parts)
        places = np.flatnonzero(codes >= 0)
        if len(places):
            yield _packed(lang, places, codes[places], [word for word in self.codes if word != b"."])


def occurrences(docs: DataFrame, text: str, group: str, block_size: int = BLOCK) -> DataFrame:
    """R_1 of whole texts; A-Z are lower-cased, null texts have no words, a null group is ``NO_LANGUAGE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = {}
        held = 0
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                marked = (raw.as_py() or b"").lower().translate(_TO_MARK)
                # What is left of white space is blank and tab.
                tokens = marked.replace(b".", b" . ").split()
                start = 0
                while start < len(tokens):
                    end = len(tokens)
                    if end - start > block_size:
                        # A very long text is cut where a piece ends.
                        try:
                            end = tokens.index(b".", start + block_size) + 1
                        except ValueError:
                            end = len(tokens)
                    block = blocks.setdefault(lang, _Block())
                    block.add(tokens[start:end])
                    held += end - start
                    start = end
                    if held >= block_size:
                        yield from chain.from_iterable(b.packed(name) for name, b in blocks.items())
                        blocks, held = {}, 0
        yield from chain.from_iterable(b.packed(name) for name, b in blocks.items())
        release_memory()

    lang = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit(NO_LANGUAGE))
    return docs.select(lang.alias("lang"), F.col(f"`{text}`").cast("binary").alias("__text")).mapInArrow(run, _BLOCK_FIELDS)


def word_groups(relation: DataFrame) -> DataFrame:
    """lang, phrase, n: the groups of every block of R_1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, groups, phrases in _unpacked(batches):
            yield _counted(lang, _strings(phrases), np.bincount(groups, minlength=len(phrases)))

    return relation.mapInArrow(run, _GROUP_FIELDS)


def group_counts(groups: DataFrame, least: int) -> DataFrame:
    """lang, phrase, n over all blocks, of groups with at least ``least`` occurrences."""
    return groups.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


#: The hash of a phrase turns the hash of its beginning by so many bits and mixes in the last word's.
_TURN = 7


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    lead = lang.encode() + b"\n"
    return np.fromiter((xxhash.xxh64_intdigest(lead + word, 42) for word in words), np.uint64, len(words))


def phrase_hashes(lang: str, phrases: list[bytes]) -> np.ndarray:
    """Hashes of phrases that have equally many words."""
    parts = [phrase.split(b" ") for phrase in phrases]
    out = np.zeros(len(phrases), np.uint64)
    for words in zip(*parts):
        out = longer_hashes(out, word_hashes(lang, words))
    return out


def longer_hashes(first: np.ndarray, last_word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last and of the last word."""
    return (first << np.uint64(_TURN) | first >> np.uint64(64 - _TURN)) ^ last_word


def bitmap(groups: DataFrame) -> np.ndarray:
    """One bit per frequent group, at most ``BITS`` of them whatever the input; positions agree with ``phrase_hashes``."""
    hashes = F.transform(F.split("phrase", " "), lambda word: F.xxhash64(F.concat_ws("\n", F.col("lang"), word)))
    turned = F.aggregate(
        hashes,
        F.lit(0).cast("bigint"),
        lambda mixed, word: F.shiftleft(mixed, _TURN).bitwiseOR(F.shiftrightunsigned(mixed, 64 - _TURN)).bitwiseXOR(word),
    )
    bits = groups.select(turned.bitwiseAND(F.lit(BITS - 1)).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 31 as int))")
    found = bits.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(BITS // 32, np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def _frequent(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = hashes & np.uint64(BITS - 1)
    return (bits[places >> np.uint64(5)] >> (places & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def _strings(phrases: list[bytes]) -> pa.Array:
    return pa.array(phrases, pa.binary()).cast(pa.string(), safe=False)


class _Joined:
    """Merge join of a block of R_k with itself on the next position, frequent groups only."""

    def __init__(self, lang: str, places: np.ndarray, groups: np.ndarray, phrases: list[bytes], bits: np.ndarray):
        self.lang, self.all = lang, phrases
        self.all_hashes = phrase_hashes(lang, phrases)
        kept = _frequent(bits, self.all_hashes)[groups]
        places, groups = places[kept], groups[kept]
        # Both sides are sorted by position.
        adjacent = np.flatnonzero(places[1:] == places[:-1] + 1)
        self.places = places[adjacent]
        pairs = groups[adjacent].astype(np.int64) * len(phrases) + groups[adjacent + 1]
        self.distinct, self.group, self.counts = np.unique(pairs, return_inverse=True, return_counts=True)
        self.first, self.second = self.distinct // len(phrases), self.distinct % len(phrases)
        single = b" " not in phrases[0]
        self.ends = phrases if single else [phrase.rsplit(b" ", 1)[-1] for phrase in phrases]
        self.end_hashes = self.all_hashes if single else None

    def phrases(self, some: np.ndarray | slice = slice(None)) -> pa.Array:
        first = _strings(self.all).take(pa.array(self.first[some]))
        return pc.binary_join_element_wise(first, _strings(self.ends).take(pa.array(self.second[some])), " ")

    def hashes(self) -> np.ndarray:
        ends = word_hashes(self.lang, self.ends) if self.end_hashes is None else self.end_hashes
        return longer_hashes(self.all_hashes[self.first], ends[self.second])


def next_groups(relation: DataFrame, frequent) -> DataFrame:
    """lang, phrase, n: the groups of every block of R_k+1; ``frequent`` is the broadcast bitmap of R_k's groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, places, groups, phrases in _unpacked(batches):
            joined = _Joined(lang, places, groups, phrases, frequent.value)
            yield _counted(lang, joined.phrases(), joined.counts)

    return relation.mapInArrow(run, _GROUP_FIELDS)


def next_relation(relation: DataFrame, frequent, longer) -> DataFrame:
    """R_k+1 from R_k: merge join, then semi-join with the frequent groups; both bitmaps are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, places, groups, phrases in _unpacked(batches):
            joined = _Joined(lang, places, groups, phrases, frequent.value)
            good = _frequent(longer.value, joined.hashes())
            kept = good[joined.group]
            if kept.any():
                numbers = np.cumsum(good) - 1
                yield _packed(lang, joined.places[kept], numbers[joined.group[kept]], joined.phrases(np.flatnonzero(good)).cast(pa.binary()).to_pylist())

    return relation.mapInArrow(run, _BLOCK_FIELDS)


def phrase_groups(
    docs: DataFrame, text: str, group: str, longest: int, least: int, block_size: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, k, n) of 1 to ``longest`` words, and lang, total: all words of a language."""
    share = docs.sparkSession.sparkContext.broadcast
    relation = materialize(occurrences(docs, text, group, block_size), "occurrences-1")
    words = materialize(group_counts(word_groups(relation), 1), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.where(F.col("n") >= least)
    found, bits = frequent.withColumn("k", F.lit(1)), share(bitmap(frequent))
    for k in range(2, longest + 1):
        frequent = materialize(group_counts(next_groups(relation, bits), least), f"groups-{k}")
        found = found.unionByName(frequent.withColumn("k", F.lit(k)))
        if k < longest:
            longer = share(bitmap(frequent))
            relation, bits = materialize(next_relation(relation, bits, longer), f"occurrences-{k}"), longer
    return found, totals


def collocations(
    docs: DataFrame,
    text: str = "text",
    group: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    covered: int = COVERED,
    best: int | None = BEST,
    block_size: int = BLOCK,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of each group (None: all).

    A phrase of several words with at least ``least`` occurrences is cut after each
    of its words; the cut with the smallest score floor(10^6 a a / (l r)) counts.
    Phrases inside a longer frequent one with ``covered`` percent of their
    occurrences go.  Counts are exact, products decimal.  Words are any characters
    but blanks, tabs and the ends of pieces; repeated rows count each; without
    words there are no rows.  Other columns are not looked at.
    """
    phrases, totals = phrase_groups(docs, text, group, longest, least, block_size)
    words = F.split("phrase", " ")
    several = phrases.where("k > 1").withColumn("__words", words)

    # Sub-phrases of the longer ones, by how often the longer one occurs.
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("k") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice("__words", at, size), " ")
            ),
        )
    )
    holders = several.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("__longer"))
    holders = holders.groupBy("lang", "phrase").agg(F.max("__longer").alias("__longer"))
    kept = several.join(holders, ["lang", "phrase"], "left").where(
        F.col("__longer").isNull() | (100 * F.col("__longer") < covered * F.col("n"))
    )

    cuts = kept.select(
        "lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "__words", "k"
    ).select(
        "lang",
        "phrase",
        "a",
        "cut",
        F.array_join(F.slice("__words", F.lit(1), F.col("cut")), " ").alias("__left"),
        F.array_join(F.slice("__words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("__right"),
    )
    parts = phrases.where(F.col("k") < longest)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("__left"), F.col("n").alias("l")), ["lang", "__left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("__right"), F.col("n").alias("r")), ["lang", "__right"])
    # Counts up to 10^14; the quotient is at most 10^6.
    score = F.expr(
        "(cast(1000000 as decimal(7,0)) * cast(a as decimal(14,0)) * cast(a as decimal(14,0)))"
        " div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))"
    )
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    scored = scored.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint"))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
