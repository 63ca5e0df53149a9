"""Back-off model: probabilities sum to 1, unseen n-grams have a value, plain Python agrees."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from textloom.operators import backoff, packs

TRAIN = ["a b c a b d", "a b c", "", None, "b b b c d e e", "a c a b c e f", "x"]
HELD_OUT = [(1, "a b c z z a"), (2, "q"), (3, "e f a b d c x"), (4, None), (5, "")]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def plain_model(texts, order):
    counts = {order: Counter()}
    for text in texts:
        t = [""] * (order - 1) + (text or "").lower().split()
        counts[order].update(tuple(t[i - order + 1 : i + 1]) for i in range(order - 1, len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(gram[1:] for gram in counts[k + 1])
    return counts


def plain_discount(counts, c):
    n = [sum(1 for x in counts.values() if x == i) for i in (1, 2, 3, 4)]
    k = min(c, 3)
    if not n[0] or not n[k - 1]:
        return 0.0
    return min(max(k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1], 0.0), k)


def plain_probability(counts, context, word):
    k = len(context) + 1
    same = {g: c for g, c in counts[k].items() if g[:-1] == context}
    lower = plain_probability(counts, context[1:], word) if context else 1 / (len(counts[1]) + 1)
    total = sum(same.values())
    if not total:
        return lower
    gamma = sum(plain_discount(counts[k], c) for c in same.values()) / total
    c = same.get((*context, word), 0)
    return (c - plain_discount(counts[k], c) if c else 0) / total + gamma * lower


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_held_out_tokens_equal_plain_python(spark, order):
    model = backoff.fit_backoff(docs_of(spark, TRAIN), order)
    counts = plain_model(TRAIN, order)
    held = spark.createDataFrame(HELD_OUT, "doc_id long, text string")
    found = {(r["doc_id"], r["pos"]): r for r in backoff.score_tokens(held, model).collect()}
    tokens = 0
    for key, text in HELD_OUT:
        t = [""] * (order - 1) + (text or "").split()
        for i in range(order - 1, len(t)):
            tokens += 1
            for k in range(1, order + 1):
                want = plain_probability(counts, tuple(t[i - k + 1 : i]), t[i])
                got = found[key, i - order + 1][f"p{k}"]
                assert got > 0 and math.isclose(got, want, rel_tol=1e-9)
    assert len(found) == tokens


def test_every_context_sums_to_one(spark):
    random.seed(4)
    texts = [" ".join(random.choice("abcdefg") for _ in range(random.randint(0, 30))) for _ in range(60)]
    model = backoff.fit_backoff(docs_of(spark, texts), 3)
    known = [r["w1"] for r in model.grams[1].collect()] + ["unseen"]
    contexts = [(r["w1"], r["w2"]) for r in model.contexts[3].collect()] + [("new", "a"), ("new", "newer")]
    rows = spark.createDataFrame([(a, b, w, 1) for a, b in contexts for w in known], "w1 string, w2 string, w3 string, n long")
    found = defaultdict(lambda: [0.0, 0.0, 0.0])
    for r in backoff.ngram_probabilities(rows, model).collect():
        for k in range(3):
            found[r["w1"], r["w2"]][k] += r[f"p{k + 1}"]
    assert set(found) == set(contexts)
    assert all(math.isclose(s, 1.0, rel_tol=1e-9) for sums in found.values() for s in sums)


def test_saved_model_scores_alike(spark, tmp_path):
    model = backoff.fit_backoff(docs_of(spark, TRAIN), 3)
    model.save(str(tmp_path / "model"))
    loaded = backoff.BackoffModel.load(spark, str(tmp_path / "model"))
    held = spark.createDataFrame(HELD_OUT, "doc_id long, text string")
    one, other = (sorted(map(tuple, backoff.score_tokens(held, m).collect())) for m in (model, loaded))
    assert one == other and len(one) == 14
    measured = backoff.document_perplexity(backoff.score_tokens(held, loaded)).collect()
    assert {r["doc_id"] for r in measured} == {1, 2, 3}
    assert all(math.isclose(r["perplexity"], math.exp(r["mean_nll"])) for r in measured)


def test_nothing_to_fit_is_an_error(spark):
    with pytest.raises(ValueError):
        backoff.fit_backoff(docs_of(spark, [None, "", " . "]), 2)


def test_frequent_words_are_split(spark):
    """A word that is a third of all tokens, in texts of one and many documents."""
    random.seed(1)
    texts = [" ".join(random.choice(["the", f"w{random.randint(0, 50)}", f"v{random.randint(0, 50)}"]) for _ in range(40)) for _ in range(80)]
    model = backoff.fit_backoff(docs_of(spark, texts), 2)
    scored = backoff.score_tokens(docs_of(spark, texts), model)
    assert scored.count() == 80 * 40 and scored.where(F.col("p2").isNull() | (F.col("p2") <= 0)).count() == 0


FOLDED = [(0, "a b c a b d"), (1, "a b c z z a"), (0, "q"), (1, None), (2, "e f a b d c x"), (2, ""), (0, "a b c c"), (1, "b b b c d e e"), (1, "zoë a b")]


@pytest.mark.parametrize("tokens", [1 << 20, 4])
def test_folds_in_packs_equal_plain_python(spark, monkeypatch, tokens):
    for name in ("CHUNK_TOKENS", "BUCKET_WORDS", "BUCKET_TOKENS"):
        monkeypatch.setattr(packs, name, tokens)
    folds = (0, 1, 2)
    docs = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(FOLDED)], "doc_id long, f int, text string")
    scored = backoff.cross_fitted(docs, F.col("f"), folds)
    found = {(r["doc_id"], r["pos"]): r for r in scored.collect()}
    models = {f: plain_model([t for g, t in FOLDED if g != f], 3) for f in folds}
    tokens, sums = 0, defaultdict(list)
    for key, (f, text) in enumerate(FOLDED):
        t = ["", "", *(text or "").split()]
        for i in range(2, len(t)):
            tokens += 1
            for k in (1, 2, 3):
                want = plain_probability(models[f], tuple(t[i - k + 1 : i]), t[i])
                assert math.isclose(found[key, i - 2][f"p{k}"], want, rel_tol=1e-9, abs_tol=1e-15)
            sums[key].append(want)
    assert len(found) == tokens
    measured = {r["doc_id"]: r for r in backoff.document_nll(scored, (1, 2, 3)).collect()}
    by_rows = {r["doc_id"]: r for r in backoff.document_nll(scored.select("*"), (1, 2, 3)).collect()}
    assert set(measured) == set(sums)
    for key, r in measured.items():
        logs = sorted(-math.log(p) for p in sums[key] if p > 0)
        assert r["n"] == len(sums[key]) and math.isclose(r["nll_3"], sum(logs) / len(logs), rel_tol=1e-9)
        middle = (logs[len(logs) // 2] + logs[(len(logs) - 1) // 2]) / 2
        assert math.isclose(r["median_nll"], middle, rel_tol=1e-9) and math.isclose(by_rows[key]["median_nll"], middle, rel_tol=1e-9)


def test_repeated_keys_and_documents_without_a_fold(spark):
    rows = [(1, 0, "a b c a"), (1, 1, "a b d"), (None, 0, "b c"), (None, 1, "c a b"), (2, None, "x x x"), (3, 1, "a b c a")]
    docs = spark.createDataFrame(rows, "doc_id long, f int, text string")
    scored = backoff.cross_fitted(docs, F.col("f"), (0, 1))
    one, other = (sorted(map(str, backoff.document_nll(s, (1, 2, 3)).select("doc_id", "n", F.round("nll_3", 9), F.round("median_nll", 9)).collect())) for s in (scored, scored.select("*")))
    assert one == other and len(one) == 3 and scored.where("pos = 0").count() == 5
    with pytest.raises(ValueError):
        backoff.cross_fitted(docs, F.lit(0), (0, 1))


def test_scored_tokens_are_not_shuffled(spark):
    docs = docs_of(spark, TRAIN)
    scored = backoff.cross_fitted(docs, F.col("doc_id").cast("int") % 2, (0, 1))
    plan = backoff.document_nll(scored, (1, 2, 3))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Aggregate" not in plan and "Generate" not in plan
