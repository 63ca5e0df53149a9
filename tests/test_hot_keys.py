"""The ways that take over for large or hot groups give the same rows."""

import os
import random
import time
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import Window, functions as F
from textloom.operators import groups, likelihood as lm, ranking as rk, sampling, splits, joins
from textloom.session import CLEANUP, materialize
from textloom.sources import writers


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; the order column is unique per key."""
    dice = random.Random(1)
    data = [("hot" if i % 3 == 0 else f"k{dice.randrange(40)}", i, dice.randrange(5)) for i in range(3000)]
    data += [(None, i, 1) for i in range(3000, 3010)]
    return spark.createDataFrame(data, "k string, o long, v long")


def test_running_totals_in_tasks(spark, skewed):
    sums = {"before": F.col("v"), "rank": F.lit(1)}
    direct = rk.running_totals(skewed, ["o"], sums, keys=["k"])
    split = rk.running_totals(skewed, ["o"], sums, keys=["k"], direct_rows=0)
    assert rows(direct) == rows(split)
    down = rk.with_rank(skewed, [F.desc("o")], direct_rows=0)
    assert [r["rank"] for r in down.orderBy(F.desc("o")).collect()] == list(range(3010))


def test_split_way_spreads_the_hot_key(spark, skewed):
    laid = skewed.repartitionByRange(8, "k", "o").withColumn("task", F.spark_partition_id())
    assert laid.where("k = 'hot'").select("task").distinct().count() > 1


def test_parts_hold_the_whole_list(skewed):
    parts = rk.collect_parts(skewed, ["k"], ["o"], {"os": "o"}, part_rows=100, direct_rows=0).collect()
    assert max(len(p["os"]) for p in parts) == 100
    whole = {}
    for p in sorted(parts, key=lambda p: p["part"]):
        whole.setdefault(p["k"], []).extend(p["os"])
    wanted = {}
    for r in skewed.orderBy("o").collect():
        wanted.setdefault(r["k"], []).append(r["o"])
    assert whole == wanted


def test_paired_samples_keep_long_sources(spark):
    data = [("a", i, str(i)) for i in range(5)] + [("b", 0, "x")]
    df = spark.createDataFrame(data, "id_source string, turn int, id_sample string")
    found = groups.paired_samples(df, ["id_sample"], part_rows=2).collect()
    assert Counter(r["id_source"] for r in found) == {"a": 3}
    assert sorted(s["id_sample"] for r in found for s in r["samples"]) == list("01234")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_lookup(skewed, how):
    known = skewed.where("k != 'k3'").groupBy("k").agg(F.count("*").alias("n"), F.max("o").alias("m"))
    got = rk.salted_lookup(skewed, known, ["k"], "n", ["o"], how, hot_share=0.01)
    wanted = skewed.join(known, ["k"], how)
    assert rows(got.select(*wanted.columns)) == rows(wanted)


def test_weighted_sample_frequencies(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK", 4)
    df = spark.createDataFrame([(i, 500 if i == 7 else 1) for i in range(500)], "id int, w int")
    drawn = sampling.weighted_sample(df, F.col("w"), "id", draws=4000, seed=5).toPandas()
    assert len(drawn) == 4000 and drawn["draw"].is_unique
    assert abs((drawn["id"] == 7).mean() - 500 / 999) < 0.04
    assert drawn[drawn["id"] != 7]["id"].nunique() > 400


def test_cutoffs_are_exact(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    placed = splits.stratified_split(df, "id", "label").groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in placed} == {
        (0, "test"): 133, (0, "eval"): 67, (0, "train"): 466,
        (1, "test"): 67, (1, "eval"): 33, (1, "train"): 234,
    }
    parts = splits.with_part(df, "id", 7).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in parts] == [143] * 6 + [142]
    assert splits.take_fraction(df, "id", 0.8).count() == 800


def test_ngram_context_join_equals_window(spark, monkeypatch):
    dice = random.Random(2)
    docs = spark.createDataFrame(
        [(i, " ".join(dice.choice("the the the a b c d e".split()) for _ in range(30))) for i in range(20)],
        "doc_id int, text string",
    )
    direct = rows(lm.document_scores(docs, 2).select("doc_id", F.round("llr", 9), F.round("fast_detect", 9)))
    monkeypatch.setattr(lm, "DIRECT_ROWS", 0)
    assert rows(lm.document_scores(docs, 2).select("doc_id", F.round("llr", 9), F.round("fast_detect", 9))) == direct


def test_merge_by_text_with_many_copies(spark):
    items = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(300)], "doc_id int, text string")
    items = items.withColumn("agents", F.array(F.lit("x")))
    results = spark.createDataFrame([("same", 1), ("same", 2), ("t0", 3), ("none", 4)], "text string, result int")
    merged, unmatched = joins.merge_by_text(items, results, "y")
    assert merged.count() == 300 and merged.where("array_contains(agents, 'y')").count() == 201
    assert rows(unmatched, "result") == [(4,)]
    again, _ = joins.merge_by_text(merged.drop("result"), results, "y")
    assert again.where("size(agents) > 2").count() == 0


def test_hot_folder_gets_several_files(spark, tmp_path, skewed):
    out = str(tmp_path / "out")
    rows_ = skewed.where("k IS NOT NULL")
    writers.export_jsonl_bz2(rows_, out, "k", spread=["o"], rows_per_file=200)
    assert len(list((tmp_path / "out" / "k=hot").glob("*.bz2"))) > 1
    assert spark.read.json(out).count() == rows_.count()


def test_exact_quantile_and_auroc_split(spark, monkeypatch):
    import numpy as np
    from textloom.operators import evaluation as ev

    dice = np.random.default_rng(4)
    values = dice.normal(size=500).round(2)
    truth = (dice.random(500) < 0.4).astype(int)
    df = spark.createDataFrame([("g", float(v), int(t)) for v, t in zip(values, truth)], "g string, y_score double, y_true int")
    original = ev.running_totals
    monkeypatch.setattr(ev, "running_totals", lambda *a, **k: original(*a, **{**k, "direct_rows": 0}))
    assert ev.exact_quantile(df, "y_score", 0.99, ["g"]).first()["quantile"] == pytest.approx(np.quantile(values, 0.99))
    pos, neg = values[truth == 1], values[truth == 0]
    area = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert ev.auroc(df, ["g"]).first()["roc_auc"] == pytest.approx(area)
    assert Window is not None


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 97).alias("g")).agg(F.sum("id").alias("s"))
    written = materialize(rows, "grouped")
    for _ in range(50):  # executors delete them a little later
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert left == set() and written.count() == 97
    assert spark.conf.get(CLEANUP, None) != "true"
