"""Nearest neighbours by multi-index hashing of learned binary codes.

* Learned: the directions of largest variance of a bounded sample, rotated so
  that signs lose as little as possible, turn a vector into a code of at most 64 bits.
* Indexed: a code is split into substrings; every vector has one index entry per
  substring, kept in blocks by the leading bits of the substring.
* Probed: if two codes differ in at most r bits, some of the m substrings differ
  in at most floor(r / m) (pigeonhole).  A query goes to every block whose
  leading bits allow that, finds the buckets within floor(r / m) there, keeps
  codes within r, and reranks them by the distance of the original vectors.
* The radius r is learned too: it covers a share of the true neighbours inside
  the sample.  Neighbours in the whole table are nearer than those in a sample,
  so it errs to the wide side.  A query with fewer than k neighbours within r
  is searched once more with a radius that admits every code.

Equal vectors are one index entry with their smallest ids, as many as a query
can use, and equal queries are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators.ranking import seeded_hash
from textloom.session import materialize

#: Vectors to fit on, at most; taken in the order of a hash of the id.
SAMPLE_ROWS = 4096
#: Longest code, substring length, share of true neighbours the radius covers.
BITS, SUBSTRING_BITS, COVERAGE = 64, 16, 0.97
#: Index entries and queries that meet in one task at a time, at most.
BLOCK_ROWS = 8192


@dataclass(frozen=True)
class Coder:
    """Centre, directions with rotation, number of substrings, radius."""

    centre: np.ndarray
    directions: np.ndarray  # dimensions x bits
    parts: int
    radius: int

    @property
    def bits(self) -> int:
        return self.directions.shape[1]

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """Code of each row as an unsigned 64-bit integer."""
        signs = (rows - self.centre) @ self.directions >= 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def substring(self, codes: np.ndarray, part: int) -> np.ndarray:
        return ((codes >> np.uint64(part * SUBSTRING_BITS)) & np.uint64((1 << SUBSTRING_BITS) - 1)).astype(np.uint16)


def fit(rows: np.ndarray, k: int, seed: int = 5, rounds: int = 40) -> Coder:
    """Learn centre, rotation and radius from sample rows."""
    centre = rows.mean(axis=0)
    bits = min(BITS, rows.shape[1])
    _, _, axes = np.linalg.svd(rows - centre, full_matrices=True)
    flat = (rows - centre) @ axes[:bits].T
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ rotation >= 0, 1.0, -1.0).T @ flat)
        rotation = (u @ v).T
    coder = Coder(centre, axes[:bits].T @ rotation, -(-bits // SUBSTRING_BITS), bits)
    asked = rows[:256]
    codes = coder.encode(rows)
    far = (asked**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None] - 2 * asked @ rows.T
    far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(far, axis=1)[:, : min(k, max(1, len(rows) - 1))]
    apart = np.bitwise_count(codes[: len(asked), None] ^ codes[near])
    radius = int(np.quantile(apart, COVERAGE, method="higher")) if len(rows) > 1 else bits
    return Coder(coder.centre, coder.directions, coder.parts, radius)


def usable_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """__id and __v (doubles) of rows that take part: with an id, no null or
    non-finite component, not all zero."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        table.select(F.col(f"`{key}`").cast("bigint").alias("__id"), v.alias("__v"))
        .where(F.col("__id").isNotNull() & F.col("__v").isNotNull() & finite & F.exists("__v", lambda x: x != 0))
        .distinct()
    )


def _search(queries: DataFrame, index: DataFrame, coder: Coder, radius: int, k: int) -> DataFrame:
    """__class of every query with the k nearest ids found: __class, vec_id, score."""
    m = coder.parts
    within = radius // m
    n_index = index.count()
    # Leading bits: so many that an even spread gives blocks of about BLOCK_ROWS.
    lead = int(np.clip(np.ceil(np.log2(max(1, n_index) / BLOCK_ROWS)), 0, SUBSTRING_BITS))
    shift = SUBSTRING_BITS - lead

    def leading(code: Column, part: Column) -> Column:
        substring = F.call_function("shiftright", code, (part * SUBSTRING_BITS).cast("int")).bitwiseAND(2**SUBSTRING_BITS - 1)
        return F.shiftright(substring, shift).cast("int")

    entries = index.select(
        "__class", "__v", "__ids", "__code", F.explode(F.array(*[F.lit(p) for p in range(m)])).alias("__part")
    ).withColumn("__block", leading(F.col("__code"), F.col("__part")))
    # Blocks that are larger all the same are dealt out over several cells.
    sizes = entries.groupBy("__part", "__block").agg(F.count("*").alias("__n"))
    cells = materialize(sizes.withColumn("__cells", F.ceil(F.col("__n") / BLOCK_ROWS).cast("int")).drop("__n"), "cells")
    groups = max(1, -(-queries.count() // BLOCK_ROWS))  # of queries
    placed = (
        entries.join(cells, ["__part", "__block"])
        .withColumn("__cell", F.pmod(F.xxhash64("__class"), F.col("__cells")).cast("int"))
        .withColumn("__group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    )
    # Probing: leading bits that differ from the query's in at most `within` places.
    masks = F.array(*[F.lit(x) for x in range(1 << lead) if x.bit_count() <= within])
    asked = (
        queries.withColumn("__part", F.explode(F.array(*[F.lit(p) for p in range(m)])))
        .withColumn("__mask", F.explode(masks))
        .withColumn("__block", leading(F.col("__code"), F.col("__part")).bitwiseXOR(F.col("__mask")))
        .join(cells, ["__part", "__block"])
        .withColumn("__cell", F.explode(F.sequence(F.lit(0), F.col("__cells") - 1)))
        .withColumn("__group", F.pmod(F.xxhash64("__class"), F.lit(groups)).cast("int"))
    )

    def meet(key: tuple, questions: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"__class": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(questions) or not len(block):
            return none
        part = int(key[0])
        ask, have = np.stack(questions["__v"].to_numpy()), np.stack(block["__v"].to_numpy())
        ask_code = questions["__code"].to_numpy().view(np.uint64)
        have_code = block["__code"].to_numpy().view(np.uint64)
        sub = coder.substring(have_code, part)
        buckets, bucket_of = np.unique(sub, return_inverse=True)
        have_norm = (have**2).sum(axis=1)
        out = []
        for i in range(len(ask)):
            probe = coder.substring(ask_code[i : i + 1], part)
            near = np.bitwise_count(buckets ^ probe) <= within
            at = np.flatnonzero(near[bucket_of])
            at = at[np.bitwise_count(have_code[at] ^ ask_code[i]) <= radius]
            if not len(at):
                continue
            rough = have_norm[at] - 2.0 * (have[at] @ ask[i])
            if len(at) > k:
                kth = np.partition(rough, k - 1)[k - 1]
                at = at[rough <= kth + 1e-9 * (1.0 + abs(kth))]
            score = np.sqrt(((have[at] - ask[i]) ** 2).sum(axis=1))
            out += [(questions["__class"].iat[i], vec, s) for j, s in zip(at, score) for vec in block["__ids"].iat[j]]
        return pd.DataFrame(out, columns=["__class", "vec_id", "score"]) if out else none

    keys = ["__part", "__block", "__cell", "__group"]
    found = (
        asked.select(*keys, "__class", "__v", "__code")
        .groupBy(*keys)
        .cogroup(placed.select(*keys, "__class", "__v", "__code", "__ids").groupBy(*keys))
        .applyInPandas(meet, "__class long, vec_id long, score double")
    )
    best = found.groupBy("__class", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("__class").orderBy("score", "vec_id")
    return best.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")


def nearest(
    table: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for every query row.

    Score is the Euclidean distance of the original vectors in doubles; ties go
    to the smaller id; a query's own id is no candidate.  Rows whose vector is
    null, zero, or has a null or non-finite component, or whose id is null, take
    no part, nor do vectors of another length than the most frequent one (of
    equal frequency, the shorter).  Repeated rows count once; one id with two
    vectors is found by the nearer one.  Fewer than k candidates: all of them.
    An empty table gives no rows.  Other columns are not read.
    """
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = materialize(usable_vectors(table, key, vector), "vectors")
    lengths = usable.groupBy(F.size("__v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return empty
    fitting = F.size("__v") == lengths.d
    usable = usable.where(fitting)
    asked = usable_vectors(queries, key, vector).where(fitting)

    sample = usable.orderBy(seeded_hash(3, "__id"), "__id", "__v").limit(SAMPLE_ROWS).select("__v").collect()
    coder = fit(np.array([r[0] for r in sample]), k)
    shared = spark.sparkContext.broadcast(coder)  # a few matrices of the vector length

    @F.pandas_udf("long")
    def code(rows: pd.Series) -> pd.Series:
        return pd.Series(shared.value.encode(np.stack(rows.to_numpy())).view(np.int64) if len(rows) else [], dtype="int64")

    # Equal vectors: their smallest ids, one more than a query needs, cut before the shuffle.
    number = F.row_number().over(Window.partitionBy("__v").orderBy("__id"))
    few = usable.withColumn("__r", number).where(F.col("__r") <= k + 1).drop("__r")
    classes = few.groupBy("__v").agg(F.sort_array(F.collect_list("__id")).alias("__ids"))
    index = materialize(classes.select(F.col("__ids")[0].alias("__class"), "__v", "__ids", code("__v").alias("__code")), "index")

    by_vector = asked.groupBy("__v").agg(F.min("__id").alias("__class"))
    questions = materialize(by_vector.withColumn("__code", code("__v")), "questions")

    # One more than asked for: a query's own id may be among them.
    first = materialize(_search(questions, index, coder, coder.radius, k + 1), "found")
    enough = first.groupBy("__class").count().where(F.col("count") > k)
    short = materialize(questions.join(enough, "__class", "left_anti"), "short")
    if short.isEmpty():
        found = first
    else:
        again = _search(short, index, coder, coder.bits, k + 1)
        found = first.join(short.select("__class"), "__class", "left_anti").unionByName(again)

    ids = asked.join(questions.select("__v", "__class"), "__v").select(F.col("__id").alias("query_id"), "__class")
    mine = ids.join(found, "__class").where("query_id <> vec_id")
    mine = mine.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
