"""MinHash near-duplicates with fast similarity sketching.

A sketch has ``BANDS * ROWS`` coordinates.  In round i every shingle draws one
coordinate and a value i + v with v in [0, 1); a coordinate keeps its smallest
value.  After as many rounds as there are coordinates, round ``coordinates + j``
sends every shingle to coordinate j, so at the latest then each one is filled.
Rounds stop once none is empty; a long text needs two or three, not one hash
per coordinate and shingle.

Texts with the same words are one class and sketched classes that agree in a
band share a bucket.  A bucket does not give all its pairs:

1. every member is compared with the bucket's smallest member, on whole sets;
2. what is linked so far is joined into components, and only buckets that
   still hold several components go on: blocks of members meet in a task that
   counts common shingles and returns links between components.

Nothing is left out but pairs whose sizes rule a link out, so no candidate pair
of a bucket is lost, and pairs are never listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import map_texts, text_hash
from textloom.llm.graph import components
from textloom.session import materialize

#: A pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
PERCENT = 80
#: Members of a bucket in a block, about.
BLOCK_ROWS = 512
#: Bits of the filter that keeps unwanted texts from being shuffled (2 MB of bits).
FILTER_BITS = 1 << 24

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_HALF = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(raw: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.lower() changes nothing else."""
    return raw.lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``width`` words; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(mixed)


class Sketcher:
    """Fast similarity sketches with a fixed number of coordinates."""

    def __init__(self, size: int, seed: int = 1):
        self.size = size
        self.seeds = _mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def sketch(self, items: np.ndarray) -> np.ndarray:
        """One 64-bit value per coordinate: round in the upper half, value in the lower."""
        size = self.size
        out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        done = 0
        while done < size:
            step = min(size - done, max(1, 2 * size // len(items)))
            rounds = np.arange(done, done + step, dtype=np.uint64)
            drawn = _mix(items[None, :] ^ self.seeds[done : done + step, None])
            place = ((drawn >> _HALF) * np.uint64(size)) >> _HALF
            value = (rounds[:, None] << _HALF) | (drawn & np.uint64(0xFFFFFFFF))
            np.minimum.at(out, place.ravel().astype(np.int64), value.ravel())
            done += step
            # Rounds beyond the one that fills the last coordinate change nothing.
            if (out != np.iinfo(np.uint64).max).all():
                return out
        for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
            drawn = _mix(items ^ self.seeds[size + j])
            out[j] = (np.uint64(size + j) << _HALF) | (drawn & np.uint64(0xFFFFFFFF)).min()
        return out

    def bands(self, items: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """One signed 64-bit bucket per band."""
        parts = self.sketch(items).reshape(bands, rows)
        mixed = np.arange(1, bands + 1, dtype=np.uint64)
        for i in range(rows):
            mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
        return mixed.view(np.int64)


def sketches(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """__id, __hash (of the text), __words (digest of the word sequence), n_shingles, bands (null without words)."""

    def compute(texts: list[bytes | None]) -> dict:
        sketcher = Sketcher(bands * rows)
        found: dict[str, list] = {"__words": [], "n_shingles": [], "bands": []}
        for raw in texts:
            words = words_of(raw or b"")
            items = shingle_hashes(words, width)
            found["__words"].append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
            found["n_shingles"].append(len(items))
            found["bands"].append(sketcher.bands(items, bands, rows).tolist() if words else None)
        return found

    source = docs.select(F.col(key).alias("__id"), text_hash(F.col(text)).alias("__hash"), F.col(text).alias("__text"))
    return map_texts(source, "__text", ["__id", "__hash"], "__words binary, n_shingles long, bands array<long>", compute)


def _shingles(raw: bytes, width: int) -> set:
    words = words_of(raw)
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(width)]))


def with_common(pairs: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b, __ta, __tb) as a, b, common, either: sizes of intersection and union of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, set()
        for batch in batches:
            common, either = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                left, right = x.as_py(), y.as_py()
                if left != last:
                    last, last_set = left, _shingles(left, width)
                other = _shingles(right, width)
                both = len(last_set & other)
                common.append(both)
                either.append(len(last_set) + len(other) - both)
            columns = [batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(either, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "common", "either"])

    narrow = pairs.select("a", "b", F.col("__ta").cast("binary"), F.col("__tb").cast("binary"))
    return narrow.mapInArrow(run, "a long, b long, common long, either long")


def _maybe_in(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a bitmap of the wanted keys lets through: all that are wanted and few others.

    So that texts nobody asked for are not shuffled.  The bitmap has at most
    ``FILTER_BITS`` / 64 words, whatever the input, which bounds the broadcast;
    with more wanted keys it lets more through, and the join after it decides.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))

    def word(position: Column) -> Column:
        return F.shiftright(position, 6)

    bitmap = wanted.select(word(bit).alias("__word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(keys)}), 64L) as int))").alias("__one"))
    bitmap = bitmap.groupBy("__word").agg(F.bit_or("__one").alias("__bits"))
    place = F.pmod(F.xxhash64(*keys), F.lit(64)).cast("int")
    return (
        rows.withColumn("__word", word(bit))
        .join(F.broadcast(bitmap), "__word")
        .where(F.getbit("__bits", place) == 1)
        .drop("__word", "__bits")
    )


def texts_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """cid and text (__t) of the wanted classes, written once."""
    names = classes.join(ids, "cid", "left_semi").select("cid", F.col("__hash").alias("__h")).distinct()
    names = materialize(names, "wanted")
    source = docs.select(F.col(key).alias("cid"), F.col(text).alias("__t")).withColumn("__h", text_hash(F.col("__t")))
    texts = (
        _maybe_in(source, names, ["cid", "__h"])
        # Not a semi join: the optimizer would move that below the bitmap and shuffle every text.
        .join(names, ["cid", "__h"])
        .dropDuplicates(["cid", "__h"])
        .select("cid", "__t")
    )
    return materialize(texts, "texts")


def linked_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough.

    The joins may be split by size, so a class with very many pairs is no single task.
    """
    left = texts.select(F.col("cid").alias("a"), F.col("__t").alias("__ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("__t").alias("__tb"))
    found = with_common(pairs.join(right, "b").join(left, "a").select("a", "b", "__ta", "__tb"), width)
    return found.where(f"100 * common >= {percent} * either").select("a", "b")


def links_between(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between different components within each bucket; members: bucket, cid, component.

    Pairs are never rows.  A bucket is cut into blocks of about ``BLOCK_ROWS``
    members, every two blocks meet in a task, and there the common shingles of
    one member with all others are counted through an index from shingle to
    members.  All links are found; of a member and another component one is
    returned.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("__blocks"))
    own, other = F.pmod(F.xxhash64("cid"), F.col("__blocks")).cast("int"), F.col("__other")
    dealt = (
        members.join(sizes, "bucket")
        .withColumn("__own", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .select("bucket", "cid", "component", "__own", F.least("__own", other).alias("__i"), F.greatest("__own", other).alias("__j"))
    )

    def meet(table: pa.Table) -> pa.Table:
        cids, labels, block = (table.column(c).to_numpy() for c in ("cid", "component", "__own"))
        links: list[tuple[int, int]] = []
        if len(np.unique(labels)) > 1:
            numbers: dict[tuple, int] = {}
            sets = [
                np.array([numbers.setdefault(s, len(numbers)) for s in _shingles(t, width)], dtype=np.int64)
                for t in table.column("__t").to_pylist()
            ]
            sizes_ = np.array([len(s) for s in sets])
            holder = np.repeat(np.arange(len(sets)), sizes_)
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            holders, starts = holder[order], np.searchsorted(flat[order], np.arange(len(numbers) + 1))
            most = np.bincount(np.unique(labels, return_inverse=True)[1]).argmax()
            major = np.unique(labels)[most]
            two = len(np.unique(block)) > 1
            for y in np.flatnonzero(labels != major):  # every pair of components has a member here
                common = np.bincount(
                    np.concatenate([holders[starts[s] : starts[s + 1]] for s in sets[y]]), minlength=len(sets)
                )
                good = (100 * common >= percent * (sizes_ + sizes_[y] - common)) & (labels != labels[y])
                if two:
                    good &= block != block[y]
                found = np.flatnonzero(good)
                _, first = np.unique(labels[found], return_index=True)
                links += [(int(cids[y]), int(cids[x])) for x in found[first]]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    with_text = dealt.join(texts.select("cid", F.col("__t").cast("binary").alias("__t")), "cid")
    return with_text.groupBy("bucket", "__i", "__j").applyInArrow(meet, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """__id, __hash, n_shingles, component_id, kept for every row.

    Rows are linked if 100 * |A and B| >= percent * |A or B| for their sets of
    ``width`` words (a shorter text is one shingle); component_id is the
    smallest id reachable, kept says that the row's id is that one.  Null and
    empty texts have an empty set, are linked with nothing and kept.  Rows with
    the same id count as one document: texts of one id are linked, and repeated
    rows get the same result.  Rows with a null id are not compared: their
    component_id is null and they are kept.  An empty table gives no rows.
    __hash tells texts of one id apart, to join the result back.
    """
    found = materialize(sketches(docs, key, text, width, bands, rows), "sketches")
    usable = found.where(F.col("__words").isNotNull() & F.col("__id").isNotNull())

    # --- one class per word sequence, named by its smallest id --------------
    classes = usable.groupBy("__words").agg(
        F.min(F.struct("__id", "__hash")).alias("__first"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    )
    classes = materialize(
        classes.select("__words", F.col("__first.__id").alias("cid"), F.col("__first.__hash").alias("__hash"), "n", "bands"),
        "classes",
    )
    members = classes.select("cid", F.explode("bands").alias("bucket"))

    # --- every bucket's members against its smallest ------------------------
    buckets = members.groupBy("bucket").agg(F.min("cid").alias("hub"), F.max("cid").alias("__last"))
    buckets = materialize(buckets.where("hub < __last").select("bucket", "hub"), "shared")
    # Most buckets hold one class; the bitmap keeps their members from being shuffled again.
    shared = _maybe_in(members, buckets, ["bucket"]).join(buckets, "bucket").where("cid <> hub")
    shared = materialize(shared.select("bucket", "cid", "hub"), "buckets")
    size = classes.select("cid", "n")
    star = (
        shared.select(F.col("hub").alias("a"), F.col("cid").alias("b"))
        .distinct()
        .join(size.select(F.col("cid").alias("a"), F.col("n").alias("__na")), "a")
        .join(size.select(F.col("cid").alias("b"), F.col("n").alias("__nb")), "b")
        .where(100 * F.least("__na", "__nb") >= percent * F.greatest("__na", "__nb"))
        .select("a", "b")
    )
    wanted = shared.select("cid").unionByName(shared.select(F.col("hub").alias("cid"))).distinct()
    texts = texts_of(wanted, classes, docs, key, text)
    first_links = materialize(linked_pairs(star, texts, width, percent), "linked")

    # --- rows of one id with several texts ----------------------------------
    belongs = materialize(usable.join(classes.select("__words", "cid"), "__words").drop("__words", "bands"), "belongs")
    several = belongs.groupBy("__id").agg(F.min("cid").alias("__low"), F.max("cid").alias("__high"))
    several = several.where("__low < __high").select("__id", "__low")
    same_id = belongs.join(several, "__id").select(F.col("__low").alias("a"), F.col("cid").alias("b")).where("a <> b")

    # --- what is left in buckets with several components ---------------------
    label = components(first_links)
    inside = shared.join(label.select(F.col("id").alias("cid"), "component"), "cid", "left").select(
        "bucket", "cid", F.coalesce("component", "cid").alias("component")
    )
    inside = materialize(inside, "inside")
    # The same members in several buckets are looked at once; two sums of hashes name a set of members.
    named = (
        inside.groupBy("bucket")
        .agg(
            F.min("component").alias("__lo"),
            F.max("component").alias("__hi"),
            F.count("*").alias("__n"),
            F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("__s1"),
            F.sum(F.xxhash64(F.lit(1), "cid").cast("decimal(20,0)")).alias("__s2"),
        )
        .where("__lo < __hi")
    )
    open_ = named.groupBy("__n", "__s1", "__s2").agg(F.min("bucket").alias("bucket")).select("bucket")
    left = materialize(inside.join(open_, "bucket", "left_semi"), "open")
    more_links = links_between(left, texts, width, percent).distinct()

    # --- final components ----------------------------------------------------
    so_far = label.select(F.col("id").alias("a"), F.col("component").alias("b"))
    final = components(so_far.unionByName(more_links).unionByName(same_id))
    linked_rows = belongs.join(final, F.col("cid") == F.col("id"), "left").select(
        "__id", "__hash", "n_shingles", F.coalesce("component", "cid").alias("component_id")
    )
    others = found.where(F.col("__words").isNull() | F.col("__id").isNull()).select(
        "__id", "__hash", "n_shingles", F.when(F.col("__words").isNull(), F.col("__id")).alias("component_id")
    )
    return linked_rows.unionByName(others).withColumn(
        "kept", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(True))
    )
