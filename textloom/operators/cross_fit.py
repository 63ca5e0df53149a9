"""Counts of back-off models of three words for every fold of a corpus, in packs (see ``packs``).

The model of a fold is fitted on the documents of all others.  The counts follow those of
``backoff.fit_backoff``: triples are counted with two pads before a text; a pair counts the
different words before it, a word the different words (or the pad) before it.  Three exchanges follow
each other, of triples, of pairs and of words; chunks get the counts of their own fold's model.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.operators import packs as pk
from textloom.session import densely_written, materialize

PADS = 2

#: What a bucket says: to a chunk, to a bucket of the next exchange, to the driver.
ANSWER, NEXT, HISTOGRAM = 0, 1, 2
_SAID = ["kind", "bucket", "chunk", "part", "b0", "b1", "b2", "b3", "b4", "h"]
_SCHEMA = "kind int, bucket int, chunk long, part int, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary, h array<long>"


class _Said:
    """Rows of one bucket."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, kind: int, bucket: int, chunk: int, part: int, blobs: Sequence[bytes] = (), h: Sequence[int] = ()) -> None:
        self.rows.append((kind, bucket, chunk, part, *blobs, *[None] * (5 - len(blobs)), [int(x) for x in h]))

    def table(self) -> pa.Table:
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64())]
        columns = list(zip(*self.rows)) if self.rows else [[]] * len(_SAID)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=_SAID)


def kinds(counts: np.ndarray, groups: np.ndarray, size: int) -> list[np.ndarray]:
    """Of each group the sum, and how many counts are 1, 2 and more."""
    chosen = [counts == 1, counts == 2, counts > 2]
    return [pk.summed(groups, counts, size), *[np.bincount(groups[c], minlength=size) for c in chosen]]


def histogram(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def _triples(bits: int, buckets: int, folds: Sequence[int]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        b, said, mask = pk.bucket_of(table, bits), _Said(), (1 << bits) - 1
        bucket, chunks, parts = table.column("bucket")[0].as_py(), pk.column(table, "chunk"), np.array(pk.column(table, "part"))
        entry_part = np.repeat(parts, b.triple_sizes)
        whole = pk.summed(b.triple_at, b.m, len(b.triples))
        context, second = b.triples >> bits, pk.unmixed(b.pairs, 2 * bits) & mask
        two, three = (np.append(0, np.cumsum(sizes)) for sizes in (b.pair_sizes, b.triple_sizes))
        for fold in folds:
            mine = entry_part == fold
            counts = whole - pk.summed(b.triple_at[mine], b.m[mine], len(b.triples))
            of_context = kinds(counts, context, len(b.pairs))
            said.add(HISTOGRAM, bucket, -1, fold, h=histogram(counts))
            for i in np.flatnonzero(parts == fold):
                pairs, triples = b.pair_at[two[i] : two[i + 1]], b.triple_at[three[i] : three[i + 1]]
                said.add(ANSWER, bucket, chunks[i], fold, [pk.packed(counts[triples]), *[pk.packed(v[pairs]) for v in of_context]])
            seen = counts > 0
            tails, n = np.unique(pk.mixed((second[context[seen]] << bits) | (b.triples[seen] & mask), 2 * bits), return_counts=True)
            cuts = pk.bounds(tails, 2 * bits, buckets)
            for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                if y > x:
                    said.add(NEXT, i, -1, fold, [pk.ascending(tails[x:y]), pk.packed(n[x:y])])
        return said.table()

    return run


def _pairs(bits: int, buckets: int, folds: Sequence[int]) -> Callable[[pa.Table], pa.Table]:
    """Of the rows of a bucket, those of a chunk ask, the others count."""

    def run(table: pa.Table) -> pa.Table:
        said, mask = _Said(), (1 << bits) - 1
        bucket, chunks, parts = table.column("bucket")[0].as_py(), np.array(pk.column(table, "chunk")), np.array(pk.column(table, "part"))
        asked = [np.cumsum(pk.unpacked(x)) for x in pk.column(table, "b0")]
        known, at = np.unique(np.concatenate(asked), return_inverse=True)
        places = np.split(at, np.cumsum([len(a) for a in asked])[:-1])
        n, keys = pk.column(table, "b1"), pk.unmixed(known, 2 * bits)
        for fold in folds:
            counting = np.flatnonzero((chunks < 0) & (parts == fold))
            nothing = [np.zeros(0, np.int64)]
            counts = pk.summed(np.concatenate([*nothing, *[places[i] for i in counting]]), pk.joined(n[i] for i in counting), len(known))
            said.add(HISTOGRAM, bucket, -1, fold, h=histogram(counts))
            for i in np.flatnonzero((chunks >= 0) & (parts == fold)):
                said.add(ANSWER, bucket, chunks[i], fold, [pk.packed(counts[places[i]])])
            seen = counts > 0
            for words, of in ((keys[seen] >> bits, kinds), (keys[seen] & mask, lambda c, at, size: [np.bincount(at, minlength=size)])):
                words, at = np.unique(pk.mixed(words, bits), return_inverse=True)
                values = of(counts[seen], at, len(words))
                cuts = pk.bounds(words, bits, buckets)
                for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    if y > x:
                        said.add(NEXT, i, -1, fold, [pk.ascending(words[x:y]), *[pk.packed(v[x:y]) for v in values]])
        return said.table()

    return run


def _words(folds: Sequence[int]) -> Callable[[pa.Table], pa.Table]:
    """Rows with one value count the words before, those with four are contexts."""

    def run(table: pa.Table) -> pa.Table:
        said = _Said()
        bucket, chunks, parts = table.column("bucket")[0].as_py(), np.array(pk.column(table, "chunk")), np.array(pk.column(table, "part"))
        asked = [np.cumsum(pk.unpacked(x)) for x in pk.column(table, "b0")]
        known, at = np.unique(np.concatenate(asked), return_inverse=True)
        places = np.split(at, np.cumsum([len(a) for a in asked])[:-1])
        blobs = [pk.column(table, f"b{i}") for i in (1, 2, 3, 4)]
        contexts = np.array([x is not None for x in blobs[1]])
        nothing = [np.zeros(0, np.int64)]
        for fold in folds:
            counting = (chunks < 0) & (parts == fold)

            def total(rows: np.ndarray, values: list) -> np.ndarray:
                rows = np.flatnonzero(rows)
                return pk.summed(np.concatenate([*nothing, *[places[i] for i in rows]]), pk.joined(values[i] for i in rows), len(known))

            counts = total(counting & ~contexts, blobs[0])
            of_context = [total(counting & contexts, values) for values in blobs]
            said.add(HISTOGRAM, bucket, -1, fold, h=[*histogram(counts), counts.sum(), (counts > 0).sum()])
            for i in np.flatnonzero((chunks >= 0) & (parts == fold)):
                said.add(ANSWER, bucket, chunks[i], fold, [pk.packed(v[places[i]]) for v in (counts, *of_context)])
        return said.table()

    return run


def _word_order(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pad and the words of a chunk, mixed and ascending, and which of them stands where."""
    keys = pk.mixed(np.append(0, ids + 1), bits)
    order = np.argsort(keys)
    return keys[order], order


def _asks(bits: int, buckets: int, folds: Sequence[int], of: Callable[[dict], np.ndarray], wide: int) -> Callable[[pk.Batches], pk.Batches]:
    def run(batches: pk.Batches) -> pk.Batches:
        for row in pk.each_row(batches):
            row = {c: v.as_py() for c, v in row.items()}
            if row["part"] in folds:
                said, keys = _Said(), of(row)
                cuts = pk.bounds(keys, wide, buckets)
                for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    if y > x:
                        said.add(NEXT, i, row["chunk"], row["part"], [pk.ascending(keys[x:y])])
                yield from said.table().to_batches()

    return run


@dataclass(frozen=True)
class Counts:
    """Answers to the chunks by order, and by order and fold how many counts are 1 to 4 (for words also their sum and number)."""

    corpus: pk.Corpus
    answers: dict[int, DataFrame]
    histograms: dict[int, dict[int, list[int]]]


def count(corpus: pk.Corpus, folds: Sequence[int]) -> Counts:
    bits, buckets, folds = corpus.bits, corpus.buckets, list(folds)
    rows = corpus.chunks.select("chunk", "part", "lengths", "codes", "ids")
    asks = {
        2: _asks(bits, buckets, folds, lambda row: pk.chunk_grams(row, bits, PADS).pairs, 2 * bits),
        1: _asks(bits, buckets, folds, lambda row: _word_order(pk.unpacked(row["ids"]), bits)[0], bits),
    }
    counting = {3: _triples(bits, buckets, folds), 2: _pairs(bits, buckets, folds), 1: _words(folds)}
    requests, said, histograms = pk.gram_requests(corpus, PADS), {}, {}
    for order in (3, 2, 1):
        if order < 3:
            requests = said[order + 1].where(F.col("kind") == NEXT).unionByName(rows.mapInArrow(asks[order], _SCHEMA))
        with densely_written(rows.sparkSession):
            said[order] = materialize(requests.groupBy("bucket").applyInArrow(counting[order], _SCHEMA), f"said-{order}")
        sums = said[order].where(F.col("kind") == HISTOGRAM).groupBy("part")
        sums = sums.agg(F.array(*[F.sum(F.get("h", F.lit(i))) for i in range(6)]).alias("h"))
        histograms[order] = {f: [0] * 6 for f in folds} | {r["part"]: list(r["h"]) for r in sums.collect()}  # one row per fold
    return Counts(corpus, said, histograms)


@dataclass(frozen=True)
class Numbers:
    """Of a model: the discounts of counts of 1, 2 and more by order; sum and gamma of the empty context, number of words."""

    discounts: Mapping[int, tuple[float, float, float]]
    total: int
    gamma: float
    known: int


def _own(counts: np.ndarray, total: np.ndarray | float, discounts: tuple[float, float, float]) -> np.ndarray:
    less = np.select([counts == 1, counts == 2], discounts[:2], discounts[2])
    return np.divide(counts - less, total, out=np.zeros(len(counts)), where=counts > 0)


def _gamma(context: Sequence[np.ndarray], discounts: tuple[float, float, float]) -> np.ndarray:
    total, *some = context
    return np.divide(sum(d * k for d, k in zip(discounts, some)), total, out=np.ones(len(total)), where=total > 0)


def _chunk_probabilities(chunk: pa.Table, found: pa.Table, models: Mapping[int, Numbers], bits: int) -> list[np.ndarray]:
    """p1, p2, p3 of the tokens of a chunk from the answers it got."""
    row = {c: chunk.column(c)[0].as_py() for c in ("part", "lengths", "codes", "ids")}
    model, codes, lengths, ids = models[row["part"]], *[pk.unpacked(row[c]) for c in ("codes", "lengths", "ids")]
    said = {o: found.filter(pa.array([x == o for x in pk.column(found, "order")], pa.bool_())) for o in (1, 2, 3)}
    order = _word_order(ids, bits)[1]
    words = []
    for values in pk.in_order(said[1], "b0", "b1", "b2", "b3", "b4"):
        words.append(np.empty_like(values))
        words[-1][order] = values
    before = np.append(0, codes[:-1] + 1)
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
    d = model.discounts
    p1 = _own(words[0][codes + 1], float(model.total), d[1]) + model.gamma / float(model.known + 1)
    context = [v[before] for v in words[1:]]
    grams = pk.chunk_grams(row, bits, PADS)
    real = grams.triple_of >= 0
    (c2,) = pk.in_order(said[2], "b0")
    p2 = _own(c2[grams.pair_of[real]], context[0], d[2]) + _gamma(context, d[2]) * p1
    c3, *context = pk.in_order(said[3], "b0", "b1", "b2", "b3", "b4")
    triple = grams.triple_of[real]
    context = [v[grams.triple_pairs[triple]] for v in context]
    return [p1, p2, _own(c3[triple], context[0], d[3]) + _gamma(context, d[3]) * p2]


def _documents(chunk: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Keys and numbers of tokens of the documents of a chunk that have any."""
    lengths = pk.unpacked(chunk.column("lengths")[0].as_py())
    return chunk.column("keys").combine_chunks().flatten().filter(pa.array(lengths > 0)), lengths[lengths > 0]


def _figures(p: np.ndarray, lengths: np.ndarray, median: bool) -> pa.Array:
    """Mean or median -ln of the probabilities of each document; 0 has no logarithm and does not count."""
    doc = np.repeat(np.arange(len(lengths)), lengths)[p > 0]
    nll = -np.log(p[p > 0])
    n = np.bincount(doc, minlength=len(lengths))
    if not median:
        values = np.bincount(doc, weights=nll, minlength=len(lengths)) / np.maximum(n, 1)
    elif not len(nll):
        values = np.zeros(len(lengths))
    else:
        nll, first = nll[np.lexsort((nll, doc))], np.cumsum(n) - n
        values = sum(nll[np.minimum(first + np.maximum(n - i, 0) // 2, len(nll) - 1)] for i in (0, 1)) / 2
    return pa.array(values, mask=n == 0)


def _found(counts: Counts, models: Mapping[int, Numbers], key: str, of: Callable[[pa.Table, list], list], columns: Mapping[str, str]) -> DataFrame:
    """A row for every document of the folds that has tokens, from the probabilities of its chunk."""
    corpus, bits, names = counts.corpus, counts.corpus.bits, [key, *columns]
    kind = corpus.chunks.schema["keys"].dataType.elementType.simpleString()

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        keys, lengths = _documents(chunk)
        return pa.table([keys, *of(lengths, _chunk_probabilities(chunk, found, models, bits))], names=names)

    answers = None
    for order, said in counts.answers.items():
        mine = said.where(F.col("kind") == ANSWER).select("chunk", "bucket", F.lit(order).alias("order"), "b0", "b1", "b2", "b3", "b4")
        answers = mine if answers is None else answers.unionByName(mine)
    chunks = corpus.chunks.where(F.col("part").isin(list(models))).select("chunk", "part", "keys", "lengths", "codes", "ids")
    schema = ", ".join([f"`{key}` {kind}", *[f"{c} {t}" for c, t in columns.items()]])
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def probabilities(counts: Counts, models: Mapping[int, Numbers], key: str) -> DataFrame:
    """(key, p1, p2, p3): lists over all tokens of a document."""
    listed = lambda lengths, ps: [pk.listed(pa.array(p), lengths) for p in ps]
    return _found(counts, models, key, listed, {f"p{k}": "array<double>" for k in (1, 2, 3)})


def figures(counts: Counts, models: Mapping[int, Numbers], key: str) -> DataFrame:
    """(key, n, nll_1, nll_2, nll_3, median_nll) of a document."""

    def of(lengths: np.ndarray, ps: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array(lengths), *[_figures(p, lengths, False) for p in ps], _figures(ps[-1], lengths, True)]

    return _found(counts, models, key, of, {"n": "long", **{f"nll_{k}": "double" for k in (1, 2, 3)}, "median_nll": "double"})
