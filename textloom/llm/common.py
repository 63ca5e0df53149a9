"""Shared pieces: Arrow maps over whole texts, words, key columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A word is a run of anything but a blank, tab, line feed, vertical tab, form
#: feed or carriage return.  ``bytes.split()`` cuts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows handed to Python at once; bounds the memory of a batch of long texts.
SLICE_ROWS = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def text_hash(text: Column) -> Column:
    """Tells rows with the same id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def release_memory() -> None:
    """Give unused memory of a finished task back to the system; the worker process lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    added: str,
    compute: Callable[[list[bytes | None]], dict[str, Sequence]],
) -> DataFrame:
    """Keep some columns and add those that ``compute`` gives for a list of texts.

    ``added`` is a DDL string.  ``compute`` gets whole texts as UTF-8 bytes
    (None for null) and returns one sequence per added column.
    """
    fields = StructType.fromDDL(added)
    schema = StructType([df.schema[c] for c in keep] + fields.fields)
    types = [(f.name, to_arrow_type(f.dataType)) for f in fields]
    names = [f.name for f in schema]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                found = compute(batch.column(n).to_pylist())
                columns = [pa.array(found[name], type=kind) for name, kind in types]
                yield pa.RecordBatch.from_arrays(batch.columns[:n] + columns, names=names)
        release_memory()

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    return source.mapInArrow(run, schema)
