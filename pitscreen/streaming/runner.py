"""Run streams over stored deliveries to completion, with replay-safe sinks.

A delivery is any number of files. Each one is appended to the inbox and the
stream is resumed from its checkpoint, the way a daily run picks up a new day;
no delivery passes through a single task.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..session import scratch_path
from ..sources.sinks import merge_by_key, write_daily
from .state import ROCKSDB

Transform = Callable[[DataFrame], DataFrame]


def _resume(deliveries: Sequence[DataFrame], name: str, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Runs the stream once per delivery. Keyed state lives in RocksDB, the store that timers and state variables need."""
    spark = deliveries[0].sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    inbox, state = scratch_path(spark, f"{name}-in"), scratch_path(spark, f"{name}-state")
    for delivery in deliveries:
        delivery.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(deliveries[0].schema).parquet(inbox)
        query = start(stream).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()


def run_to_files(deliveries: Sequence[DataFrame], transform: Transform, name: str) -> DataFrame:
    """Process every delivery in order into a parquet sink and read it back."""
    spark = deliveries[0].sparkSession
    out = scratch_path(spark, f"{name}-out")
    _resume(deliveries, name, lambda s: transform(s).writeStream.format("parquet").outputMode("append").option("path", out))
    return spark.read.parquet(out)


def run_daily_sink(deliveries: Sequence[DataFrame], path: str, name: str, by: str = "as_of") -> None:
    """Write every micro-batch by replacing its days: running a delivery twice changes nothing."""
    _resume(deliveries, name, lambda s: s.writeStream.foreachBatch(lambda batch, _id: write_daily(batch, path, by)))


def run_to_table(deliveries: Sequence[DataFrame], transform: Transform, path: str, name: str, keys: Sequence[str], by: str) -> None:
    """Merge every micro-batch of the transformed stream into the table at `path` by key; only touched partitions are rewritten.

    A batch is written once before it is merged, since each use of a batch would run its stateful operator again.
    """
    def merge(batch: DataFrame, _id: int) -> None:
        spark, beside = batch.sparkSession, scratch_path(batch.sparkSession, f"{name}-batch")
        batch.write.parquet(beside)
        merge_by_key(spark.read.schema(batch.schema).parquet(beside), path, keys, by)

    _resume(deliveries, name, lambda s: transform(s).writeStream.outputMode("update").foreachBatch(merge))
