"""Shared helpers: stored intermediates, Arrow columns and small numeric pieces."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitscreen.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once into the shared folder and read it back: lineage ends there, so a lost executor
    costs a re-read and several consumers do not repeat the work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_long(column: str) -> F.Column:
    return F.col(column).cast("long")


def utf8(column: str = "text") -> F.Column:
    """The text as bytes; a null text is an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary Arrow column without a copy per row."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 19, most: int = 1024) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` rows whose texts hold about `limit` bytes; a longer text is a range of its own."""
    rows = len(offsets) - 1
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, at + most)
        yield at, to
        at = to


def batches_of(schema: pa.Schema, make: Callable[[pa.RecordBatch], dict]) -> Callable:
    """A mapInArrow function that turns each batch into one of `schema`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = make(batch)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
    return run
