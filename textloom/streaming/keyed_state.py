"""Insert-if-absent with one state per key, instead of reading the store.

The state store remembers every key that has been stored, without a limit of time
unless one is given.  A key costs one small value; state is partitioned by key and
lives in RocksDB, so it may be larger than memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are handed to Python in so many groups, each with one map from key to state.
BUCKETS = 1024


class FirstOfKey(StatefulProcessor):
    """The first rows of the keys of a bucket, by ``order`` within a micro-batch; later ones are dropped as long as the key is remembered.

    Rows are whole Python rows, not pandas: a column of longs with nulls would become doubles there.
    """

    def __init__(self, columns: list[str], key: str, kind: StructType, order: str, ttl_ms: int | None):
        self.columns, self.key, self.kind, self.order, self.ttl_ms = columns, key, kind, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", self.kind, "known boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        first = {}  # one row per key is held, however many a key has
        for row in rows:
            at = row[self.order]
            at = (True, 0) if at is None or at != at else (False, at)  # missing times come last
            held = first.get(row[self.key])
            if held is None or at < held[0]:
                first[row[self.key]] = (at, row)
        for value, (_, row) in first.items():
            name = (value is None, value)
            known = self.seen.containsKey(name)
            if not known or self.ttl_ms:  # the time a key is remembered starts anew with every row
                self.seen.updateValue(name, (True,))
            if not known:
                yield Row(**{c: row[c] for c in self.columns})

    def close(self) -> None:
        pass


def first_by_key(rows: DataFrame, key: str, order: str, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The stream without rows whose key was there before.

    ``ttl_ms`` forgets a key so many milliseconds after its last row; by default it is never forgotten.
    ``key`` is of a simple type, ``order`` is a numeric or time column.  Rows without a key are one key.  A checkpoint
    belongs to its number of buckets.
    """
    kind = StructType([StructField("missing", BooleanType()), StructField("key", rows.schema[key].dataType)])
    bucketed = rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    return bucketed.groupBy("__bucket").transformWithState(
        statefulProcessor=FirstOfKey(rows.columns, key, kind, order, ttl_ms),
        outputStructType=StructType(rows.schema.fields),
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


def insert_first_by_key(rows: DataFrame, out: str, key: str, order: str, checkpoint: str, ttl_ms: int | None = None) -> list[dict]:
    """Store each key once; returns, per micro-batch that had input, its number, rows and the rows held in state.

    The file sink logs its batches and the state belongs to the checkpoint, so a
    repeated batch stores nothing twice.
    """
    spark = rows.sparkSession
    # Without rows there is nothing to forget: a batch of its own for that would follow without end.
    wanted = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        writer = (
            first_by_key(rows, key, order, ttl_ms)
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
        )
        query = writer.start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
        return [
            {"batch": p.batchId, "rows": p.numInputRows, "keys": sum(s.numRowsTotal for s in p.stateOperators)}
            for p in query.recentProgress
            if p.numInputRows
        ]
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
