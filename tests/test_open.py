"""Functions over rows and open metadata."""

import json

import pytest
from pyspark.sql import functions as F
from textloom.functions import variants as vr
from textloom.operators import table_functions as tf


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_flat_map_gives_any_number_of_rows(spark):
    df = spark.createDataFrame([(1, "baz"), (2, "qux"), (0, "none")], "foo int, bar string")
    twice = tf.flat_map(df, lambda x: (x, x) if x["foo"] else (), df.schema)
    assert rows(twice) == [(1, "baz"), (1, "baz"), (2, "qux"), (2, "qux")]
    many = tf.flat_map(df, lambda x: ({"i": i} for i in range(10_000 * x["foo"])), "i long, absent string")
    assert many.count() == 30_000 and many.where("absent IS NULL").count() == 30_000
    with pytest.raises(Exception, match="no such columns"):
        tf.flat_map(df, lambda x: [{"other": 1}], "i long").collect()


def test_zipped_lists_by_sql(spark):
    """The golden example of a flat map with a list per row."""
    tf.register(spark)
    df = spark.createDataFrame([(1, "baz", [123, 456]), (2, "qux", [789]), (3, "none", None)], "foo int, bar string, baz array<int>")
    df.createOrReplaceTempView("zipped")
    found = spark.sql("SELECT * FROM explode_zipped(TABLE(zipped), 'baz')")
    assert found.columns == ["foo", "bar", "baz"] and found.schema["baz"].dataType.simpleString() == "int"
    assert rows(found) == [(1, "baz", 123), (1, "baz", 456), (2, "qux", 789)]
    both = spark.sql("SELECT * FROM explode_zipped(TABLE(SELECT 1 AS k, array('a', 'b') AS x, array(1.5D, 2.5D, 3.5D) AS y), 'x', 'y')")
    assert rows(both) == [(1, "a", 1.5), (1, "b", 2.5)]
    with pytest.raises(Exception, match="not a list column"):
        spark.sql("SELECT * FROM explode_zipped(TABLE(zipped), 'bar')").collect()


def test_runs_of_a_partition(spark):
    tf.register(spark)
    values = "aabbbaccac"
    data = [(k, i, v) for k in (1, 2) for i, v in enumerate(values if k == 1 else values[::-1])] + [(3, 0, None)]
    spark.createDataFrame(data, "k int, o int, v string").repartition(4).createOrReplaceTempView("runs")
    found = spark.sql("SELECT * FROM equal_runs(TABLE(runs) PARTITION BY k ORDER BY (o), 'k', 'o', 'v')")
    one = sorted((r["first"], r["last"], r["v"], r["n"]) for r in found.where("k = 1").collect())
    assert one == [(0, 1, "a", 2), (2, 4, "b", 3), (5, 5, "a", 1), (6, 7, "c", 2), (8, 8, "a", 1), (9, 9, "c", 1)]
    assert found.where("k = 2").agg(F.sum("n")).first()[0] == 10 and found.where("k = 3").collect()[0]["n"] == 1


MIXED = [
    (1, '{"a": 1, "nested": {"deep": [1, "two", {"x": null}]}}'),
    (2, '{"a": "text", "only_here": true}'),
    (3, '{"a": 2.5}'),
    (4, "[1, 2]"),
    (5, "not json"),
    (6, None),
]


def test_nested_and_mixed_values_survive(spark, tmp_path):
    df = spark.createDataFrame(MIXED, "id int, j string").select("id", vr.open_value(F.col("j")).alias("v"))
    df.write.parquet(str(tmp_path / "v"))
    back = {r["id"]: r["j"] for r in spark.read.parquet(str(tmp_path / "v")).select("id", F.to_json("v").alias("j")).collect()}
    for key, text in MIXED[:4]:
        assert json.loads(back[key]) == json.loads(text)
    assert back[5] is None and back[6] is None


def test_paths_have_types(spark):
    df = spark.createDataFrame(MIXED, "id int, j string").select("id", vr.open_value(F.col("j")).alias("v"))
    found = df.select(
        "id",
        vr.read_path(F.col("v"), "$.a", "double"),
        vr.read_path(F.col("v"), "$.nested.deep[1]", "string"),
        vr.read_path(F.col("v"), "$.only_here", "boolean"),
    )
    assert rows(found) == [(1, 1.0, "two", None), (2, None, None, True), (3, 2.5, None, None)] + [(i, None, None, None) for i in (4, 5, 6)]


def test_keys_that_only_some_rows_have(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, 5), (3, None, None)], "id int, `odd name` string, b int")
    packed = vr.with_open_metadata(df, ["id"])
    found = {r["id"]: json.loads(r["j"]) for r in packed.select("id", F.to_json("metadata").alias("j")).collect()}
    assert found == {1: {"odd name": "x"}, 2: {"b": 5}, 3: {}}
    assert vr.merged_schema(packed, "metadata").first()[0] == "OBJECT<b: BIGINT, `odd name`: STRING>"
    assert rows(vr.flattened(packed, "metadata")) == [(1, "odd name", "x"), (2, "b", "5")]
