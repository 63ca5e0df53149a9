"""Functions that turn a row, or an ordered group of rows, into any number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Rows that a batch of results holds, about.
RESULT_ROWS = 4096


def flat_map(df: DataFrame, function: Callable[[dict], Iterable[Mapping]], schema: StructType | str) -> DataFrame:
    """The rows that ``function`` gives for each row, a dictionary by column; none, one or many.

    Keys that a result lacks are null, others than those of ``schema`` are an
    error.  Rows go to Python and back in Arrow batches; results are handed over
    as they come, however many there are.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = set(fields.names)
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Mapping] = []
        for batch in batches:
            for row in batch.to_pylist():
                for result in function(row):
                    if not names.issuperset(result):
                        raise ValueError(f"no such columns: {sorted(set(result) - names)}")
                    found.append(result)
                    if len(found) >= RESULT_ROWS:
                        yield pa.RecordBatch.from_pylist(found, schema=target)
                        found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=target)

    return df.mapInArrow(run, fields)


def _name(argument: AnalyzeArgument) -> str:
    if not argument.isConstantExpression or not isinstance(argument.value, str):
        raise ValueError("columns are named by constant strings")
    return argument.value


@udtf
class ExplodeZipped:
    """``explode_zipped(TABLE(t), 'a', 'b')``: the rows of t, lists a and b replaced by their elements side by side.

    The result has as many rows for a row as its shortest list has elements.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, *names: AnalyzeArgument) -> AnalyzeResult:
        listed = [_name(n) for n in names]
        fields = {f.name: f for f in rows.dataType.fields}
        for name in listed:
            if name not in fields or not isinstance(fields[name].dataType, ArrayType):
                raise ValueError(f"not a list column: {name}")
        kept = [f for f in rows.dataType.fields if f.name not in listed]
        return AnalyzeResult(StructType(kept + [StructField(n, fields[n].dataType.elementType) for n in listed]))

    def eval(self, row: Row, *names: str):
        kept = tuple(row[c] for c in row.__fields__ if c not in names)
        for values in zip(*[row[n] or [] for n in names]):
            yield kept + values


@udtf
class EqualRuns:
    """``equal_runs(TABLE(t) PARTITION BY k ORDER BY (o), 'k', 'o', 'v')``: rows k, v, first, last, n.

    One row per run of neighbouring rows of a key with equal values, with the
    order's value of its first and last row.  Only one run of a key is held.
    """

    def __init__(self):
        self.run = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        fields = {f.name: f for f in rows.dataType.fields}
        key_field, order_field, value_field = (fields[_name(a)] for a in (key, order, value))
        return AnalyzeResult(
            StructType(
                [
                    key_field,
                    value_field,
                    StructField("first", order_field.dataType),
                    StructField("last", order_field.dataType),
                    StructField("n", LongType()),
                ]
            )
        )

    def eval(self, row: Row, key: str, order: str, value: str):
        if self.run is not None and self.run[1] == row[value]:
            self.run = (*self.run[:3], row[order], self.run[4] + 1)
            return
        if self.run is not None:
            yield self.run
        self.run = (row[key], row[value], row[order], row[order], 1)

    def terminate(self):
        if self.run is not None:
            yield self.run


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    spark.udtf.register("explode_zipped", ExplodeZipped)
    spark.udtf.register("equal_runs", EqualRuns)
