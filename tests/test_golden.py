"""Documented examples of the row operators."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from textloom.operators import arrays, groups, joins
from textloom.operators import rows as ops


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(0, 1, "baz"), (1, 2, "qux")], "id int, foo int, bar string")


def test_map(base):
    out = base.select((F.col("foo") * 2).alias("abc"), "bar")
    assert rows(out) == [(2, "baz"), (4, "qux")]


def test_flat_map_twice(base):
    out = ops.flat_map_rows(base, [F.col("foo")], [F.col("foo")])
    assert rows(out) == [(1,), (1,), (2,), (2,)]


def test_flat_map_zip(spark, base):
    other = spark.createDataFrame([(0, [123, 456]), (1, [789])], "n int, baz array<int>")
    zipped = joins.zip_join(base, other, ["id"], ["n"])
    assert rows(zipped.select("foo", F.explode("baz"))) == [(1, 123), (1, 456), (2, 789)]


def test_zip_update_and_shortest_wins(spark):
    left = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6]), (2, [7, 8, 9])], "id int, v array<int>")
    right = spark.createDataFrame([(0, [1, 2]), (1, [4, 5])], "n int, w array<int>")
    assert rows(joins.zip_join(left, right, ["id"], ["n"]), "id", "w") == [(0, [1, 2]), (1, [4, 5])]


def test_apply(spark):
    df = spark.createDataFrame([("bar", "one"), ("baz", "two"), ("qux", "three")], "foo string, abc string")
    assert rows(ops.apply_column(df, F.upper, "FOO2", "foo"), "FOO2") == [("BAR",), ("BAZ",), ("QUX",)]
    both = ops.apply_column(df, lambda a, b: F.concat_ws("-", a, b), "foo", "abc")
    assert rows(both, "foo") == [("bar-one",), ("baz-two",), ("qux-three",)]
    dashed = spark.createDataFrame([("a-b",), ("x-y",), ("1-2",)], "s string")
    split = ops.apply_column(dashed, lambda s: F.split(s, "-"), "s")
    assert rows(split) == [(["1", "2"],), (["a", "b"],), (["x", "y"],)]


def test_group(spark):
    df = spark.createDataFrame(
        [(0, 1, "baz", [1, 2, 3]), (1, 1, "baz", [4, 5, 6]), (2, 2, "qux", [7, 8, 9])],
        "id int, foo int, bar string, values array<int>",
    )
    out = groups.group_documents(df, "foo", ["id"], ["foo", "bar"], ["values"])
    assert rows(out, "foo", "bar", "values") == [
        (1, "baz", [[1, 2, 3], [4, 5, 6]]),
        (2, "qux", [[7, 8, 9]]),
    ]


def test_group_keeps_last_present_value(spark):
    df = spark.createDataFrame([(0, 1, "a"), (1, 1, "b"), (2, 1, None)], "id int, k int, v string")
    assert rows(groups.group_documents(df, "k", ["id"], ["v"], ["id"]), "k", "v", "id") == [
        (1, "b", [0, 1, 2])
    ]


def test_sort_documents(spark):
    df = spark.createDataFrame([([3, 1, 2], ["c", "a", "b"])], "value array<int>, other array<string>")
    assert rows(arrays.sort_arrays_by(df, "value", "other", reverse=True)) == [([3, 2, 1], ["c", "b", "a"])]
    kept = arrays.sort_arrays_by(df, "value", "other", reverse=True, include_by=False)
    assert rows(kept) == [([3, 1, 2], ["c", "b", "a"])]
    uneven = spark.createDataFrame([([3, 1], ["c"])], "value array<int>, other array<string>")
    with pytest.raises(Exception, match="differ in length"):
        arrays.sort_arrays_by(uneven, "value", "other").collect()


def test_sort_by(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "value int, name string")
    assert [r["value"] for r in ops.sort_by(df, "value").collect()] == [1, 2, 3]
    dropped = ops.sort_by(df, "value", reverse=True, drop_key="value").collect()
    assert [tuple(r) for r in dropped] == [("c",), ("b",), ("a",)]
    lengths = spark.createDataFrame([(1, [1, 2, 3]), (2, [1]), (3, [1, 2])], "id int, input_ids array<int>")
    assert [r["id"] for r in ops.sort_by_length(lengths).collect()] == [2, 3, 1]


def test_labels(spark):
    df = spark.createDataFrame([("human",), ("ai",), ("fusion",), ("x",)], "n string")
    coded = df.select("n", ops.encode_label(F.col("n")).alias("i"))
    assert rows(coded) == [("ai", 1), ("fusion", 2), ("human", 0), ("x", None)]
    assert rows(coded.select(ops.decode_label(F.col("i")))) == [("ai",), ("fusion",), ("human",), (None,)]


def test_required_fields(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(ops.filter_required_fields(df, ["a", "b"])) == [(2, "x")]
    with pytest.raises(KeyError):
        ops.filter_required_fields(df, ["c"])
