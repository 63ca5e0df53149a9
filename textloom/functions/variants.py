"""Open metadata: values whose fields are not known beforehand, as VARIANT columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def open_value(json: Column) -> Column:
    """Any JSON text as a variant; null where it is not valid."""
    return F.try_parse_json(json)


def open_columns(columns: Sequence[str]) -> Column:
    """The columns as one object without those that are null, so a key is kept only where it has a value."""
    return F.parse_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))


def read_path(value: Column, path: str, kind: str) -> Column:
    """What lies at a path such as ``$.a.b[0]``, as a type; null where the path or the type does not fit."""
    return F.try_variant_get(value, path, kind)


def with_open_metadata(df: DataFrame, known: Sequence[str], out: str = "metadata") -> DataFrame:
    """The known columns and one variant with all others."""
    rest = [c for c in df.columns if c not in known]
    return df.select(*[F.col(f"`{c}`") for c in known], open_columns(rest).alias(out))


def merged_schema(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, schema): the type that holds all values of the column, per group; an aggregate, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.schema_of_variant_agg(F.col(column)).alias("schema"))


def flattened(df: DataFrame, column: str) -> DataFrame:
    """One row per top-level key of an object: the other columns, key, value (JSON text)."""
    others = [f"`{c}`" for c in df.columns if c != column]
    names = F.map_entries(F.from_json(F.to_json(F.col(column)), "map<string,string>"))
    return df.select(*[F.col(c) for c in others], F.inline(names))
