"""Work and memory that must not grow faster than the table (findings of round 3)."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from conftest import rows
from textloom import session
from textloom.functions import tokens as tk
from textloom.functions.statistics import with_text_metrics
from textloom.operators import likelihood as lm, models as md, ranking as rk, sentences as st, windows as wn
from textloom.plans import registry, streaming_queries, window_queries
from textloom.streaming import jobs

TEXTS = [(1, "a b a b. C a"), (2, ""), (3, None), (4, "b"), (5, "a b a b c c c ab abc"), (5, "b a")]


def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_follow_the_size_of_the_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_BYTES", 4096)
    for docs in (registry.corpus(spark, sf_dir), registry.spread_corpus(spark, sf_dir)):
        assert docs.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_offsets_are_found_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(tk, "SLICE_BYTES", 10)
    found = list(tk._in_slices(iter([pa.array(["ab, c", None, "", "é d " * 9, "x"]), pa.array([], pa.string())]), True))
    assert len(found) > 2
    lists = [r for part in found for r in part.to_pylist()]
    assert lists[:3] == [{"start": [0, 4], "end": [2, 5], "token": ["ab", "c"]}] + [{"start": [], "end": [], "token": []}] * 2
    assert lists[3]["start"] == list(range(0, 36, 2)) and lists[4]["token"] == ["x"]


def test_ngrams_are_made_without_a_lambda(spark):
    for order in lm.ORDERS:
        grams = lm.ngram_rows(texts(spark), order)
        assert "lambda" not in plan(grams)
        expected = []
        for key, text in TEXTS:
            t = [w.strip(".").lower() for w in (text or "").split()]
            expected += [(key, i, *t[i - order + 1 : i + 1]) for i in range(order - 1, len(t))]
        assert rows(grams) == sorted(expected, key=repr)
        counts = {tuple(r)[:-1]: r["c"] for r in lm.ngram_counts(texts(spark), order).collect()}
        assert counts == {g: [e[2:] for e in expected].count(g) for g in {e[2:] for e in expected}}


def test_repeated_words_are_counted_without_a_lambda_over_pairs(spark):
    docs = spark.createDataFrame([("the the a",), ("a A aa a b b c",), ("",), ("- -",), ("x " * 30_000,)], "text string")
    measured = with_text_metrics(docs)
    assert "zip_with" not in plan(measured)
    found = [(r["n_words"], round(r["type_token_ratio"], 6), round(r["hapax_ratio"], 6)) for r in measured.collect()]
    assert found == [(3, 0.666667, 0.333333), (7, 0.571429, 0.285714), (0, 0.0, 0.0), (0, 0.0, 0.0), (30_000, 0.000033, 0.0)]


def test_windows_are_cut_before_they_are_grouped(spark):
    docs = spark.createDataFrame([(1, [str(i) for i in range(300)]), (2, [])], "k long, t array<string>")
    whole = wn.reassemble_windows(wn.sliding_token_windows(docs, "t", 64, 16), "k")
    grouped = next(line for line in plan(whole).splitlines() if "Aggregate" in line)
    assert "slice(" not in grouped
    assert {r["k"]: r["tokens"] for r in whole.collect()} == {1: [str(i) for i in range(300)], 2: []}


def test_standardize_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def dear(x):
        seen.add(1)
        return float(x)

    scaled = md.standardize(spark.range(4).select("id", dear("id").alias("x")), ["x"])
    assert [round(r["x"], 4) for r in scaled.orderBy("id").collect()] == [-1.3416, -0.4472, 0.4472, 1.3416]
    assert seen.value == 4


def test_levels_and_kept_continuations_are_worked_out_once(spark):
    model = lm.ngram_model(lm.train(texts(spark), 2), 2)
    nodes = lm.branch_paths(model, spark.createDataFrame([("a",)], "token string"), k=2, depth=3)
    assert "Join" not in plan(nodes) and "Window" not in plan(nodes)
    assert ("b", 1, "a b") in rows(nodes, "token", "depth", "path")
    assert plan(lm.filter_top_p(model, 2, 0.5)).count("Window") == 1


def test_micro_batches_keep_every_core_busy(spark, sf_dir, monkeypatch):
    asked = []
    read = jobs.read_files
    monkeypatch.setattr(jobs, "read_files", lambda *a, **b: asked.append(b["files_per_trigger"]) or read(*a, **b))
    found = streaming_queries.stream_features(spark, sf_dir)
    assert asked[0] >= spark.sparkContext.defaultParallelism
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_places_of_possible_ends_are_found_once(spark, monkeypatch):
    model = st.learn_boundaries(texts(spark))
    calls, ends = [], st.possible_ends
    monkeypatch.setattr(st, "possible_ends", lambda *a, **b: calls.append(1) or ends(*a, **b))
    st.no_ends(texts(spark), model).collect()
    assert len(calls) == 1
    assert "lambda" not in plan(st.token_counts(texts(spark)))
    assert rows(st.token_counts(texts(spark).where("doc_id < 5"))) == [
        ("C", True, 1), ("a", False, 2), ("a", True, 1), ("b", False, 1), ("b", True, 1), ("b.", False, 1)
    ]


def test_one_model_lies_on_disk_at_a_time(spark, monkeypatch):
    written, most = set(), []
    write, drop = lm.materialize, lm.release

    def seen(df, label):
        out = write(df, label)
        written.add(out._textloom_path)
        most.append(sum("ngrams" in p or "scoring" in p for p in written))
        return out

    monkeypatch.setattr(lm, "materialize", seen)
    monkeypatch.setattr(lm, "release", lambda t: (written.discard(t._textloom_path), drop(t)))
    found = lm.scores_per_layer(texts(spark).where("doc_id < 5"), lm.one_at_a_time(texts(spark).where("doc_id < 5")))
    assert rows(found, "doc_id", "layer", "n") == [(1, 1, 5), (1, 2, 5), (1, 3, 4)]
    assert max(most) <= 2 and not [p for p in written if "layer" not in p]


def test_layers_are_scored_in_shares_of_their_ngrams(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c a b d. a b c"), (2, "b c a x"), (2, "a b"), (3, None), (None, "c a b d")], "doc_id long, text string")
    r9 = [F.round(c, 9) for c in ("llr", "fast_detect")]
    plain = [(k, o, *r) for o in lm.ORDERS for k, *r in rows(lm.document_scores(docs, o).select("doc_id", "n", *r9))]
    looked, look = [], lm.salted_lookup
    monkeypatch.setattr(lm, "salted_lookup", lambda left, *a, **k: looked.append(left.count()) or look(left, *a, **k))
    found = lm.scores_per_layer(lm.tokenized(docs), lm.one_at_a_time(docs))
    assert sorted(rows(found.select("doc_id", "layer", "n", *r9)), key=str) == sorted(plain, key=str)
    assert len(looked) == sum(lm.PARTS.values()) > 3 and sum(looked) == 15 + 15 + 11


def test_a_share_of_an_order_is_a_small_part_of_its_tokens(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{(i * i + k) % 97}" for i in range(k, k + 200))) for k in range(5)], "doc_id long, text string")
    looked, sums, most = [], set(), []
    look, write, drop = lm.salted_lookup, lm.materialize, lm.release

    def seen(df, label):
        out = write(df, label)
        if label == "layer_sums":
            sums.add(out._textloom_path)
            most.append(len(sums))
        return out

    monkeypatch.setattr(lm, "salted_lookup", lambda left, *a, **k: looked.append(left.count()) or look(left, *a, **k))
    monkeypatch.setattr(lm, "materialize", seen)
    monkeypatch.setattr(lm, "release", lambda t: (sums.discard(t._textloom_path), drop(t)))
    found = lm.scores_per_layer(lm.tokenized(docs), lm.one_at_a_time(lm.tokenized(docs), (3,)))
    assert rows(found, "doc_id", "n") == [(k, 198) for k in range(5)]
    assert sum(looked) == 5 * 198 and max(looked) < 0.2 * sum(looked)
    assert max(most) == 2 and not sums  # those of all shares before, and with the new one


def test_a_context_is_sorted_once(spark):
    counts = lm.train(texts(spark), 3)
    scoring = lm.scoring_model(counts, 3)
    executed = scoring._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", executed.split("Initial Plan")[0])) == 1
    assert {(r["w1"], r["w2"], r["w3"], r["c"], r["rank"], round(r["p"], 6)) for r in scoring.where("w1 = 'a' and w2 = 'b'").collect()} == {
        ("a", "b", "a", 2, 0, 0.5), ("a", "b", "c", 2, 1, 0.5)
    }


def test_sizes_of_groups_are_bounded_by_buckets(spark, monkeypatch):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (2,), (None,)], "k int")
    asked, largest = [], rk.largest_group
    monkeypatch.setattr(rk, "largest_group", lambda d, keys: asked.append(list(keys)) or largest(d, keys))
    assert rk.groups_within(df, ["k"], 3) and asked == [["__bucket"]]
    assert not rk.groups_within(df, ["k"], 2) and not rk.groups_within(df, [], 5)
    monkeypatch.setattr(rk, "HASH_BUCKETS", 1)  # all in one bucket: the groups themselves decide
    assert rk.groups_within(df, ["k"], 3) and asked[-1] == ["k"]


def test_places_are_those_of_the_regular_expression():
    texts = ["", "Zoë's  x", None, "a\u0301b_ 𝒜9\n٣", "\n,", "ß\u0001İ", None]
    found = [p for part in tk._in_slices(iter([pa.array(texts), pa.array([], pa.string())]), False) for p in part.to_pylist()]
    assert found == [[dict(zip(("start", "end"), m.span())) for m in tk._TOKEN.finditer(t or "")] for t in texts]


def test_sentences_are_measured_once(spark, sf_dir, monkeypatch):
    for query in (window_queries.token_to_char_spans, window_queries.span_labels):
        once = plan(query(spark, sf_dir))
        assert once.count("regexp_replace(text") == 1 and once.count("_token_places(text") == 1
    monkeypatch.setattr(session, "SPREAD_BYTES", 4096)  # both sides of the join are dealt alike, whatever their columns
    dealt = window_queries.mixed(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"RepartitionByExpression \[doc_id#\d+L?\], (\d+)", dealt))) == 1


def test_feature_length_is_the_number_of_tokens(spark):
    docs = spark.createDataFrame(
        [(1, "A b. \t C? d\u0001e!  \u0001 . -- ! "), (2, " . "), (3, None), (4, ""), (5, "a. b."), (5, "c d. e"), (None, "x. y")],
        "doc_id long, text string",
    )
    named = wn.sentence_token_spans(docs, "doc_id", F.size(tk.token_list(F.col("text"))))
    found = rows(wn.sentence_token_spans(docs, "doc_id").where("doc_id = 1"))
    assert found == rows(named.where("doc_id = 1")) == [(1, 0, 0, 2), (1, 1, 2, 3), (1, 2, 3, 4), (1, 3, 4, 5)]
    assert wn.sentence_token_spans(docs, "doc_id").count() == named.count()
