"""Daily outputs: partitioned by day and safe to rewrite."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

IMMUTABLE_AFTER_DAYS = 120


def write_daily(df: DataFrame, path: str, by: str = "as_of", tasks: int | None = None) -> None:
    """Replace only the days present in `df`; other days stay as they are.

    Rows are rebalanced by day first: few files per day, and a large day is split over tasks. A backfill of many
    small days gives `tasks`: then each day is one file and that many tasks write them, where rebalancing by size
    would leave all to a few."""
    dealt = df.hint("rebalance", by) if tasks is None else df.repartition(tasks, by)
    (dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def merge_by_key(rows: DataFrame, path: str, keys: Sequence[str], by: str) -> None:
    """Replace or add rows of a table partitioned by `by`, which the keys determine. `rows` holds one row per key.

    Stored rows of the touched partitions without a new version are kept by an anti-join; those partitions are put
    together beside the table first and then replaced, so a merge that fails can simply be run again.
    """
    spark = rows.sparkSession
    if rows.isEmpty():
        return
    if _exists(spark, path):
        stored = spark.read.schema(rows.schema).parquet(path)
        touched = rows.select(by).distinct()
        kept = stored.join(touched, by, "left_semi").join(rows.select(*keys), list(keys), "left_anti")
        beside = scratch_path(spark, "merge")
        rows.unionByName(kept.select(*rows.columns)).write.parquet(beside)
        rows = spark.read.schema(rows.schema).parquet(beside)
    write_daily(rows, path, by)


def append_missing_caps(requests: DataFrame, existing: DataFrame, today: Column, compute) -> DataFrame:
    """Grid rows still to compute: old dates are final once stored, recent ones are recomputed.
    `compute` maps requests(ticker, as_of) to the same rows with their cap."""
    final = existing.where(F.datediff(today, "as_of") > IMMUTABLE_AFTER_DAYS).select("ticker", "as_of")
    return compute(requests.join(final, ["ticker", "as_of"], "left_anti"))


def refresh_cap_grid(requests: DataFrame, existing: DataFrame, today: Column, compute) -> DataFrame:
    """The whole grid after a refresh: untouched final rows plus recomputed ones."""
    keep = existing.where(F.datediff(today, "as_of") > IMMUTABLE_AFTER_DAYS)
    fresh = append_missing_caps(requests, existing, today, compute)
    return keep.select("ticker", "as_of", "mcap").unionByName(fresh.select("ticker", "as_of", "mcap"))


def refresh_stored_grid(spark: SparkSession, path: str, requests: DataFrame, today: Column, compute: Callable[[DataFrame], DataFrame]) -> None:
    """Bring the cap grid stored at `path`, partitioned by month, up to date: what is final and stored stays as it is,
    everything else that is asked for is computed and replaces its stored version. Months without such rows are not
    rewritten. `compute` maps requests(ticker, as_of) to the same rows with `mcap`."""
    schema = "ticker string, as_of date, mcap double, month date"
    existing = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    fresh = append_missing_caps(requests.select("ticker", "as_of").distinct(), existing, today, compute)
    fresh = fresh.select("ticker", "as_of", F.col("mcap").cast("double").alias("mcap"), F.trunc("as_of", "month").alias("month"))
    beside = scratch_path(spark, "grid")
    fresh.write.parquet(beside)      # computed once; merging reads it several times
    merge_by_key(spark.read.schema(schema).parquet(beside), path, ["ticker", "as_of"], "month")


def write_run(path: str, by: str = "as_of", tasks: int | None = None, **outputs: DataFrame) -> None:
    """The outputs of daily runs (alerts, exits, state, ...), each a table of its own below `path`, one partition per day;
    running a day again replaces that day. For `tasks` see `write_daily`."""
    for name, rows in outputs.items():
        write_daily(rows, f"{path}/{name}", by, tasks)


def recent_alerts(spark: SparkSession, path: str, today: Column, days: int = 30) -> DataFrame:
    """Stored alerts of the last days, newest first. The filter prunes partitions by day, or by
    month where the store is partitioned by `month`."""
    df = spark.read.parquet(path)
    if "month" in df.columns:
        df = df.where(F.col("month") >= F.trunc(F.date_sub(today, days), "month"))
    return recent_rows(df, today, days).orderBy(F.desc("as_of"), "ticker")


def recent_rows(df: DataFrame, today: Column, days: int = 30) -> DataFrame:
    return df.where((F.col("as_of") > F.date_sub(today, days)) & (F.col("as_of") <= today))
