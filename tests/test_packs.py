"""N-grams in packs: counts equal plain Python, keys may repeat or be null, chunks and buckets change nothing."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from textloom.operators import likelihood as lm, packs as pk
from textloom.plans import model_queries as mq

TEXTS = [(1, "a b a b. C a"), (2, ""), (3, None), (4, "b"), (5, "a b a b c c c ab abc"), (5, "b a x"), (None, "a b c ab"), (None, "zoë a"), (7, "c c")]


def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def plain():
    """(key, pos, p1, p2, p3) of all tokens but the first."""
    lists = [(key, (text or "").lower().replace(".", "").split()) for key, text in TEXTS]
    counts, before = ([Counter() for _ in range(3)] for _ in range(2))
    for _, t in lists:
        for o in range(3):
            for i in range(o, len(t)):
                counts[o][tuple(t[i - o : i + 1])] += 1
                before[o][tuple(t[i - o : i])] += 1
    found = []
    for key, t in lists:
        for i in range(1, len(t)):
            grams = [tuple(t[i - o : i + 1]) if i >= o else None for o in range(3)]
            found.append((key, i, *[g and round(counts[o][g] / before[o][g[:-1]], 9) for o, g in enumerate(grams)]))
    return sorted(found, key=repr)


def test_integers_survive_packing():
    for values in ([], [0], [0, 0], [1, 255, 256, 2**40, 0], list(range(1000))):
        assert pk.unpacked(pk.packed(np.array(values, dtype=np.int64))).tolist() == values
    for bits in (2, 6, 16):
        assert sorted(pk.mixed(np.arange(1 << bits), bits).tolist()) == list(range(1 << bits))
    hashes = pk.word_hashes(pa.array(["x", "a", "b", "a", "", "zoë"]).slice(1))
    assert hashes[0] == hashes[2] != hashes[1] and (hashes >= 0).all() and (hashes < 1 << 62).all()


@pytest.mark.parametrize("chunk, bucket", [(1 << 20, 1 << 20), (3, 2)])
def test_likelihoods_equal_plain_python(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(pk, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(pk, "BUCKET_WORDS", bucket)
    monkeypatch.setattr(pk, "BUCKET_TOKENS", bucket)
    likely = lm.token_likelihoods(texts(spark))
    assert rows(likely.select("doc_id", "pos", *[F.round(f"p{o}", 9) for o in lm.ORDERS])) == plain()
    matrix = {r["doc_id"]: r[1] for r in lm.likelihood_matrix(likely).collect()}
    grouped = {r["doc_id"]: r[1] for r in lm.likelihood_matrix(likely.select("*")).collect()}  # by rows
    assert matrix == grouped and sorted(matrix, key=repr) == [1, 5, 7, None] and len(matrix[5]) == 10


def test_tokens_are_not_rows_of_a_shuffle(spark):
    likely = lm.token_likelihoods(texts(spark).where("doc_id < 5"))
    for df in (likely, lm.likelihood_matrix(likely)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_no_tokens_give_no_rows(spark):
    likely = lm.token_likelihoods(spark.createDataFrame([(1, None), (2, " . ")], "doc_id long, text string"))
    assert likely.collect() == [] and lm.likelihood_matrix(likely).collect() == []


def test_matrices_are_not_joined(spark, sf_dir, monkeypatch):
    """The labels meet vectors of a fixed length, not the matrices."""
    written, write = {}, mq.materialize
    monkeypatch.setattr(mq, "materialize", lambda df, label: written.update({label: df}) or write(df, label))
    monkeypatch.setattr(mq.ev, "binary_metrics", lambda scored: scored.groupBy("y_true").agg(F.avg("y_score").alias("s")))
    for query, label in ((mq.sequence_feature_classifier, "matrices"), (mq.sequence_convolution, "kernels")):
        assert 1 <= query(spark, sf_dir).count() <= 2
        moved = [line for line in written[label]._jdf.queryExecution().optimizedPlan().toString().split("Join")[0].splitlines()]
        assert "intermediate_likelihoods" not in "".join(moved) and set(written) <= {"matrices", "kernels"}


def test_features_of_a_document_are_made_where_its_tokens_are(spark, monkeypatch):
    """Tokens are grouped by document before anything is moved."""
    seen, write = {}, lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, label: seen.update({label: df}) or write(df, label))
    found = lm.vector_features(lm.token_likelihoods(texts(spark)), "doc_id", ["p2 v-div p1 s-max", "p1 s-l2"])
    assert found.count() == 4
    plan = seen["features"]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Generate" in plan.split("Exchange")[1] and "HashAggregate" in plan.split("Exchange")[1].split("Generate")[0]
