"""A sink that shows whole results only: tasks write parts, the commit writes a manifest.

``df.write.format("committed_lines").option("path", folder)`` writes one file of JSON
lines, or one XML file per row, for each task below ``folder``.  What counts is the
manifest, written last with the time, the totals and the parts; a failed job removes
its parts, and parts that no manifest names are no data.  Tasks may still run when their
job has failed, so it first leaves a mark, and a task that finds it removes its own files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "committed_lines"
MANIFESTS = "_manifests"
ABORTED = "_aborted"


@dataclass
class Part(WriterCommitMessage):
    files: list[str]
    rows: int
    bytes: int


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict):
        self.path = options["path"].rstrip("/")
        self.form = options.get("form", "json")
        if self.form not in ("json", "xml"):
            raise ValueError(f"no such form: {self.form}")
        self.names = schema.names
        self.job = uuid.uuid4().hex

    def _xml(self, row: dict) -> str:
        fields = "".join(f"<{k}>{escape(str(v))}</{k}>" for k, v in row.items() if v is not None)
        return f"<?xml version='1.0' encoding='UTF-8'?>\n<document>{fields}</document>\n"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        """One task: its files carry the attempt, so one that is tried again never meets the files of the first try."""
        files, folder = _opened(self.path)
        files.create_dir(folder, recursive=True)
        context = TaskContext.get()
        stem = f"part-{self.job}-{context.partitionId()}-{context.taskAttemptId()}"
        part = Part([], 0, 0)
        try:
            if self.form == "xml":
                for batch in batches:
                    for row in batch.to_pylist():
                        name, text = f"{stem}-{part.rows}.xml", self._xml(row).encode()
                        part.files.append(name)
                        with files.open_output_stream(f"{folder}/{name}") as out:
                            out.write(text)
                        part.rows, part.bytes = part.rows + 1, part.bytes + len(text)
            else:
                name = f"{stem}.jsonl"
                part.files.append(name)
                with files.open_output_stream(f"{folder}/{name}") as out:
                    for batch in batches:
                        for row in batch.to_pylist():
                            line = (json.dumps(row, ensure_ascii=False, default=str) + "\n").encode()
                            out.write(line)
                            part.rows, part.bytes = part.rows + 1, part.bytes + len(line)
            if files.get_file_info(f"{folder}/{ABORTED}/{self.job}").type != pafs.FileType.NotFound:
                raise RuntimeError(f"job {self.job} has failed")
        except BaseException:
            for name in part.files:
                _remove(files, f"{folder}/{name}")
            raise
        return part

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None and m.rows]
        for m in messages:
            if m is not None and not m.rows:
                self._drop(m)
        manifest = {
            "job": self.job,
            "collected_at": datetime.now(timezone.utc).isoformat(),
            "form": self.form,
            "rows": sum(m.rows for m in parts),
            "bytes": sum(m.bytes for m in parts),
            "parts": [{"file": m.files[0], "files": len(m.files), "rows": m.rows, "bytes": m.bytes} for m in parts],
        }
        files, folder = _opened(self.path)
        files.create_dir(f"{folder}/{MANIFESTS}", recursive=True)
        # Written aside and moved, so a manifest is there wholly or not at all.
        aside = f"{folder}/{MANIFESTS}/.{self.job}"
        with files.open_output_stream(aside) as out:
            out.write(json.dumps(manifest).encode())
        files.move(aside, f"{folder}/{MANIFESTS}/{self.job}.json")

    def abort(self, messages: list[Part | None]) -> None:
        """Remove all parts of the job, also of tasks that were killed; one that still writes finds the mark when it ends."""
        files, folder = _opened(self.path)
        files.create_dir(f"{folder}/{ABORTED}", recursive=True)
        with files.open_output_stream(f"{folder}/{ABORTED}/{self.job}"):
            pass
        for found in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if found.base_name.startswith(f"part-{self.job}-"):
                _remove(files, found.path)

    def _drop(self, part: Part) -> None:
        files, folder = _opened(self.path)
        for name in part.files:
            _remove(files, f"{folder}/{name}")


def _remove(files: pafs.FileSystem, path: str) -> None:
    if files.get_file_info(path).type != pafs.FileType.NotFound:
        files.delete_file(path)


class CommittedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        if overwrite:
            raise ValueError("this sink only appends")
        return CommittedWriter(schema, self.options)


def write_committed(df: DataFrame, path: str, form: str = "json") -> None:
    df.sparkSession.dataSource.register(CommittedLines)
    df.write.format(FORMAT).option("path", path).option("form", form).mode("append").save()


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per committed job: job, collected_at, form, rows, bytes, parts."""
    schema = (
        "job string, collected_at timestamp, form string, rows long, bytes long,"
        " parts array<struct<file: string, files: long, rows: long, bytes: long>>"
    )
    return spark.read.schema(schema).json(f"{path}/{MANIFESTS}")


def read_committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of committed JSON parts; parts that no manifest names are left out.

    The file's name is joined with the manifests, so the list of parts stays a table.
    """
    known = manifests(spark, path).where("form = 'json'").select(F.explode("parts.file").alias("__file"))
    rows = spark.read.schema(schema).option("pathGlobFilter", "part-*.jsonl").json(path)
    named = rows.withColumn("__file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return named.join(known, "__file", "left_semi").drop("__file")
