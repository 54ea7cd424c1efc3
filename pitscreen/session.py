"""Session settings and the shared folder used to cut lineage."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(app: str = "pitscreen", master: str | None = None, shuffle_partitions: int | None = None,
                **conf: str) -> SparkSession:
    """Build (or fetch) a session with the settings every transformation assumes.

    Cluster-level sizing (executors, shuffle partitions) stays with the
    submitter; the arguments are for local runs and tests.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: the cluster's checkpoint directory.

    Only a local master may fall back to a temporary folder; on a cluster a
    missing setting is an error, because executors would not share it.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clustered(df: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    """A stored copy in the shared folder, bucketed and sorted by instrument: later windows and joins on
    the key need no exchange, scans still prune columns, and a derivation used several times runs once."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"clustered_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key, order)
     .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name)
