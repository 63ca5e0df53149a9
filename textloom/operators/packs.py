"""N-grams of a whole corpus counted and looked up in packs instead of rows.

A row per token costs far more disk and time in a shuffle than what it says.  Here the
documents are laid out in chunks of about ``CHUNK_TOKENS`` tokens.  A chunk asks
about each of its distinct words or n-grams once: what falls into a bucket of keys
goes there as one row of compressed integers, the bucket adds up what all chunks
say, and answers in the order of the questions.  A frequent key is one entry per
chunk, so no bucket grows with it.

Words are compared as strings and get integers as ids; n-grams are compared by the ids
of all their words, so nothing depends on a hash.  Hashes only choose buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType

from textloom.functions.tokens import token_list
from textloom.session import densely_written, materialize, release

#: Tokens of a chunk, unless one document has more.
CHUNK_TOKENS = 1 << 19

#: Distinct words, and tokens, that all chunks together have in a bucket.
BUCKET_WORDS = 1 << 19
BUCKET_TOKENS = 1 << 20

Batches = Iterator[pa.RecordBatch]


# --- integers as bytes -----------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Integers from 0 up, byte by byte of their places and compressed: small ones take little."""
    values = np.ascontiguousarray(values, dtype="<i8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(7, "little") + bytes([width]) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpacked(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:7], "little"), blob[7]
    wide = np.zeros((n, 8), dtype=np.uint8)
    if n and width:
        planes = pa.decompress(blob[8:], decompressed_size=n * width, codec="zstd")
        wide[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T
    return wide.view("<i8").ravel()


def ascending(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=0))


def joined(blobs: Iterable[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(unpacked, blobs)])


# --- buckets ---------------------------------------------------------------------------


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """Numbers below 2^62, the same for the same word."""
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    text = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    terms = (text.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(text)) - np.repeat(starts, sizes)]
    h = np.add.reduceat(terms, starts)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(2)).astype(np.int64)


def mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys below 2^bits, one to one and evenly spread over the same numbers."""
    x, mask, half = keys.astype(np.uint64), np.uint64((1 << bits) - 1), np.uint64(bits // 2 + 1)
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = (x * np.uint64(factor)) & mask
        x ^= x >> half
    return x.astype(np.int64)


def unmixed(values: np.ndarray, bits: int) -> np.ndarray:
    """The keys that ``mixed`` made into these numbers."""
    x, mask, half = values.astype(np.uint64), np.uint64((1 << bits) - 1), np.uint64(bits // 2 + 1)
    for factor in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15):
        x ^= x >> half
        x = (x * np.uint64(pow(factor, -1, 1 << bits))) & mask
    return x.astype(np.int64)


def bounds(ordered: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each of the equal ranges of numbers below 2^bits begins among ascending ones, and the end."""
    edges = [(i << bits) // buckets for i in range(buckets)]
    return np.append(np.searchsorted(ordered, np.array(edges, dtype=np.int64)), len(ordered))


# --- chunks ----------------------------------------------------------------------------


def each_row(batches: Batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}


def record(schema: pa.Schema | list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema)


def listed(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


_CHUNK = ["chunk", "part", "keys", "lengths", "codes", "place", "words", "n", "ends"]


def _chunk_of(number: int, part: int, keys: list[pa.Array], lengths: list[np.ndarray], words: list[pa.Array]) -> pa.RecordBatch:
    """Tokens as places in the chunk's list of words, frequent words first; ``place`` says where the words stand
    in the order of their hashes, ``n`` and ``ends`` (in this order) how often they occur, and as the last of a text."""
    sizes = np.concatenate(lengths)
    tokens = pa.concat_arrays([w.cast(pa.string()) for w in words]).dictionary_encode()
    codes = tokens.indices.to_numpy().astype(np.int64)
    counts = np.bincount(codes, minlength=len(tokens.dictionary))
    frequent = np.argsort(-counts, kind="stable")
    rank = np.empty_like(frequent)
    rank[frequent] = np.arange(len(frequent))
    codes, known = rank[codes], tokens.dictionary.take(pa.array(frequent))
    by_hash = np.argsort(word_hashes(known), kind="stable")
    place = np.empty_like(by_hash)
    place[by_hash] = np.arange(len(by_hash))
    ends = np.bincount(codes[np.cumsum(sizes)[sizes > 0] - 1], minlength=len(known))
    held = pa.concat_arrays(keys)
    return record(
        _CHUNK, [number], pa.array([part], pa.int32()), listed(held, np.array([len(held)])), [packed(sizes)], [packed(codes)], [packed(place)],
        listed(known.take(pa.array(by_hash)), np.array([len(known)])), [packed(counts[frequent][by_hash])], [packed(ends[by_hash])],
    )


def _chunks(most: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        first, made = TaskContext.get().partitionId() << 33, 0
        held: dict[int, list] = {}
        for batch in batches:
            for part in pc.unique(batch.column(2)).to_pylist():
                rows = batch.filter(pc.equal(batch.column(2), part)) if part is not None else batch.slice(0, 0)
                sizes = pc.fill_null(pc.list_value_length(rows.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                at = 0
                while at < len(sizes):
                    mine = held.setdefault(part, [[], [], [], 0])
                    upto = at + 1 + int(np.searchsorted(np.cumsum(sizes[at:]), most - mine[3]))
                    piece = rows.slice(at, upto - at)
                    # Copied, so that the batch can go.
                    mine[0].append(pa.concat_arrays([piece.column(0), piece.column(0).slice(0, 0)]))
                    mine[1].append(sizes[at:upto])
                    mine[2].append(piece.column(1).flatten())
                    mine[3] += int(sizes[at:upto].sum())
                    if mine[3] >= most:
                        yield _chunk_of(first + made, part, *held.pop(part)[:3])
                        made += 1
                    at = upto
        for part in list(held):
            if held[part][3]:
                yield _chunk_of(first + made, part, *held.pop(part)[:3])
                made += 1
        pa.default_memory_pool().release_unused()

    return run


def _word_requests(buckets: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for row in each_row(batches):
            words, n, ends = row["words"].values, unpacked(row["n"].as_py()), unpacked(row["ends"].as_py())
            cuts = bounds(word_hashes(words), 62, buckets)
            rows = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            sizes = np.array([b - a for _, a, b in rows])
            yield record(
                ["bucket", "chunk", "part", "words", "n", "ends"], pa.array([i for i, _, _ in rows], pa.int32()), [row["chunk"].as_py()] * len(rows),
                pa.array([row["part"].as_py()] * len(rows), pa.int32()), listed(words, sizes), [packed(n[a:b]) for _, a, b in rows], [packed(ends[a:b]) for _, a, b in rows],
            )

    return run


def column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def slices(arrays: list[np.ndarray], sizes: np.ndarray) -> list[list[bytes]]:
    """Each array cut into pieces of these sizes, packed."""
    cuts = np.cumsum(sizes)[:-1]
    return [[packed(piece) for piece in np.split(a, cuts)] for a in arrays]


def summed(codes: np.ndarray, weights: np.ndarray, groups: int) -> np.ndarray:
    """Sums of integers by group; doubles hold them exactly up to 2^53."""
    return np.bincount(codes, weights=weights, minlength=groups).astype(np.int64)


def _word_answers(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words = table.column("words").combine_chunks()
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        asked = words.flatten().dictionary_encode()
        codes, known = asked.indices.to_numpy().astype(np.int64), asked.dictionary
        n, ends = (summed(codes, joined(column(table, c)), len(known)) for c in ("n", "ends"))
        # Frequent words first, so that ids are small numbers mostly; then by the word, so that a repeated task gives the same ids.
        order = pc.sort_indices(pa.table({"n": n, "w": known}), sort_keys=[("n", "descending"), ("w", "ascending")]).to_numpy()
        ids = np.empty(len(known), np.int64)
        ids[order] = np.arange(len(known)) * buckets + bucket
        answers = slices([ids[codes], n[codes], ends[codes]], sizes)
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "ids": answers[0], "n": answers[1], "ends": answers[2]})

    return run


def in_order(answers: pa.Table, *names: str) -> list[np.ndarray]:
    answers = answers.sort_by("bucket")
    return [joined(column(answers, name)) for name in names]


_NUMBERED = ["chunk", "part", "keys", "lengths", "codes", "ids", "n", "ends"]


def _numbered(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    place = unpacked(chunk.column("place")[0].as_py())
    found = [packed(a[place]) for a in in_order(answers, "ids", "n", "ends")]
    return chunk.select(["chunk", "part", "keys", "lengths", "codes"]).append_column("ids", [[found[0]]]).append_column("n", [[found[1]]]).append_column("ends", [[found[2]]])


@dataclass(frozen=True)
class Corpus:
    """Written chunks of documents: their keys, numbers of tokens, the tokens as places in a list of words, and for these
    words the id, how often the corpus has them and how often as the last of a text.  ``top`` is the largest id."""

    chunks: DataFrame
    tokens: int
    top: int

    @property
    def bits(self) -> int:
        """Ids are below 2^bits, and so are ids that begin at 1 (see ``padded_tokens``)."""
        return (self.top + 1).bit_length()

    @property
    def buckets(self) -> int:
        return max(1, -(-self.tokens // BUCKET_TOKENS))


def key_type(docs: DataFrame, key: str) -> str:
    return docs.schema[key].dataType.simpleString()


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str | None = None) -> Corpus:
    """Lay the documents out in chunks and number their words.  A chunk has documents of one ``part`` (an integer) only."""
    spark, kind = docs.sparkSession, key_type(docs, key)
    has_list = isinstance(docs.schema[text].dataType, ArrayType)
    tokens = docs.select(
        F.col(key).alias("key"), (F.col(text) if has_list else token_list(F.col(text))).alias("t"), (F.lit(0) if part is None else F.col(part)).cast("int").alias("part")
    )
    schema = f"chunk long, part int, keys array<{kind}>, lengths binary, codes binary, place binary, words array<string>, n binary, ends binary"
    with densely_written(spark):
        chunks = materialize(tokens.mapInArrow(_chunks(CHUNK_TOKENS), schema), "chunks")
    asked = chunks.agg(F.sum(F.size("words"))).first()[0] or 0
    buckets = max(1, -(-asked // BUCKET_WORDS))
    requests = chunks.select("chunk", "part", "words", "n", "ends").mapInArrow(
        _word_requests(buckets), "bucket int, chunk long, part int, words array<string>, n binary, ends binary"
    )
    answers = requests.groupBy("bucket").applyInArrow(_word_answers(buckets), "chunk long, bucket int, ids binary, n binary, ends binary")
    found = chunks.select("chunk", "part", "keys", "lengths", "codes", "place").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    schema = f"chunk long, part int, keys array<{kind}>, lengths binary, codes binary, ids binary, n binary, ends binary"
    with densely_written(spark):
        done = materialize(found.applyInArrow(_numbered, schema), "numbered")
    release(chunks)
    size = done.mapInArrow(_size, "tokens long, top long").agg(F.sum("tokens"), F.max("top")).first()
    return Corpus(done, size[0] or 0, size[1] or 0)


def _size(batches: Batches) -> Batches:
    for row in each_row(batches):
        ids = unpacked(row["ids"].as_py())
        yield record(["tokens", "top"], [int(unpacked(row["lengths"].as_py()).sum())], [int(ids.max(initial=0))])


# --- n-grams of two and three words -----------------------------------------------------


@dataclass(frozen=True)
class Grams:
    """The pairs and triples of a chunk.  ``pairs`` are distinct mixed ids, ascending; ``pair_of`` says which one ends
    at a token (-1 for the first of a text).  ``triples`` are distinct, by the place of the pair before them, then by
    the id of the last word; ``triple_of`` alike (-1 for the first two)."""

    pairs: np.ndarray
    pair_counts: np.ndarray
    pair_of: np.ndarray
    triple_pairs: np.ndarray
    triple_words: np.ndarray
    triple_counts: np.ndarray
    triple_of: np.ndarray


def grams_of(ids: np.ndarray, lengths: np.ndarray, bits: int) -> Grams:
    pos = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    second = np.flatnonzero(pos >= 1)
    keys = mixed((ids[second - 1] << bits) | ids[second], 2 * bits)
    pairs, inverse, pair_counts = np.unique(keys, return_inverse=True, return_counts=True)
    pair_of = np.full(len(ids), -1, np.int64)
    pair_of[second] = inverse
    third = np.flatnonzero(pos >= 2)
    triples, inverse, triple_counts = np.unique((pair_of[third - 1] << bits) | ids[third], return_inverse=True, return_counts=True)
    triple_of = np.full(len(ids), -1, np.int64)
    triple_of[third] = inverse
    return Grams(pairs, pair_counts, pair_of, triples >> bits, triples & ((1 << bits) - 1), triple_counts, triple_of)


def padded_tokens(ids: np.ndarray, lengths: np.ndarray, pads: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that begin at 1, with so many 0 before each text that has tokens, and the lengths with these."""
    sizes = lengths + pads * (lengths > 0)
    pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros(len(pos), np.int64)
    out[pos >= pads] = ids + 1
    return out, sizes


def chunk_grams(row: dict, bits: int, pads: int = 0) -> Grams:
    ids, lengths = unpacked(row["ids"])[unpacked(row["codes"])], unpacked(row["lengths"])
    return grams_of(*(padded_tokens(ids, lengths, pads) if pads else (ids, lengths)), bits)


_REQUEST = "bucket int, chunk long, part int, pairs binary, n binary, follow binary, words binary, m binary"


def _gram_requests(bits: int, buckets: int, pads: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for row in each_row(batches):
            grams = chunk_grams({c: row[c].as_py() for c in ("ids", "codes", "lengths")}, bits, pads)
            follow = np.bincount(grams.triple_pairs, minlength=len(grams.pairs))
            cuts = bounds(grams.pairs, 2 * bits, buckets)
            rows = [(i, slice(a, b), slice(*np.searchsorted(grams.triple_pairs, (a, b)))) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield record(
                ["bucket", "chunk", "part", "pairs", "n", "follow", "words", "m"], pa.array([i for i, _, _ in rows], pa.int32()), pa.array([row["chunk"].as_py()] * len(rows), pa.int64()),
                pa.array([row["part"].as_py()] * len(rows), pa.int32()), *[
                    pa.array(blobs, pa.binary()) for blobs in (
                        [ascending(grams.pairs[two]) for _, two, _ in rows], [packed(grams.pair_counts[two]) for _, two, _ in rows], [packed(follow[two]) for _, two, _ in rows],
                        [packed(grams.triple_words[three]) for _, _, three in rows], [packed(grams.triple_counts[three]) for _, _, three in rows],
                    )
                ],
            )
        pa.default_memory_pool().release_unused()

    return run


def gram_requests(corpus: Corpus, pads: int = 0) -> DataFrame:
    """What the chunks ask every bucket about their pairs and the triples that begin with them."""
    asked = _gram_requests(corpus.bits, corpus.buckets, pads)
    return corpus.chunks.select("chunk", "part", "lengths", "codes", "ids").mapInArrow(asked, _REQUEST)


@dataclass(frozen=True)
class Bucket:
    """All requests of a bucket, one after the other: sizes of the requests, the distinct pair of each entry and its count, the
    same for triples, whose distinct values are the place of a distinct pair and a word."""

    pair_sizes: np.ndarray
    triple_sizes: np.ndarray
    pairs: np.ndarray
    pair_at: np.ndarray
    n: np.ndarray
    triples: np.ndarray
    triple_at: np.ndarray
    m: np.ndarray


def bucket_of(table: pa.Table, bits: int) -> Bucket:
    asked, words = ([unpacked(b) for b in column(table, c)] for c in ("pairs", "words"))
    pairs, pair_at = np.unique(np.concatenate([np.cumsum(a) for a in asked]), return_inverse=True)
    before = np.repeat(pair_at, joined(column(table, "follow")))
    triples, triple_at = np.unique((before << bits) | np.concatenate(words), return_inverse=True)
    sizes = [np.array([len(a) for a in part]) for part in (asked, words)]
    return Bucket(*sizes, pairs, pair_at, joined(column(table, "n")), triples, triple_at, joined(column(table, "m")))


def _gram_counts(bits: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        b = bucket_of(table, bits)
        n, m = summed(b.pair_at, b.n, len(b.pairs)), summed(b.triple_at, b.m, len(b.triples))
        ends = n - summed(b.triples >> bits, m, len(b.pairs))
        two, last = slices([n[b.pair_at], ends[b.pair_at]], b.pair_sizes)
        (three,) = slices([m[b.triple_at]], b.triple_sizes)
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": two, "ends": last, "m": three})

    return run


def gram_lists(corpus: Corpus, key: str) -> DataFrame:
    """(key, n1, ends1, n2, ends2, n3): lists over all tokens of a document, for each that has two or more.

    How often the corpus has the token, the token as the last of a text, the pair that ends here, this pair
    at the end of a text, and the triple that ends here; 0 where the text has not enough tokens before.
    """
    bits, kind = corpus.bits, corpus.chunks.schema["keys"].dataType.elementType.simpleString()
    spark = corpus.chunks.sparkSession
    answers = gram_requests(corpus).groupBy("bucket").applyInArrow(_gram_counts(bits), "chunk long, bucket int, n binary, ends binary, m binary")
    answers = materialize(answers, "counted")  # so that the requests are gone before the chunks are moved

    def lists(chunk: pa.Table, found: pa.Table) -> pa.Table:
        row = {c: chunk.column(c)[0].as_py() for c in ("lengths", "codes", "ids", "n", "ends")}
        lengths, codes = unpacked(row["lengths"]), unpacked(row["codes"])
        grams = chunk_grams(row, bits)
        n, ends, m = in_order(found, "n", "ends", "m") if found.num_rows else (np.zeros(0, np.int64),) * 3

        def at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
            return np.append(values, 0)[places]  # the place -1 is the 0 at the end

        parts = [unpacked(row["n"])[codes], unpacked(row["ends"])[codes], at(n, grams.pair_of), at(ends, grams.pair_of), at(m, grams.triple_of)]
        some = lengths >= 2
        tokens = np.repeat(some, lengths)
        keys = chunk.column("keys").combine_chunks().flatten().filter(pa.array(some))
        return pa.table([keys, *[listed(pa.array(p[tokens]), lengths[some]) for p in parts]], names=[key, *COUNTS])

    schema = f"`{key}` {kind}, " + ", ".join(f"{c} array<long>" for c in COUNTS)
    found = corpus.chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lists, schema)
    with densely_written(spark):
        written = materialize(found, "counts")
    release(answers)
    return written


COUNTS = ["n1", "ends1", "n2", "ends2", "n3"]
