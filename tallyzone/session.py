"""Session helpers: a local session for tests/bench and the shared folder.

The library never builds its own session inside operators; it only reads
settings from the session it is given.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "tallyzone") -> SparkSession:
    """Session for tests and the local benchmark (never used on a cluster)."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(2, int(cpus)))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TALLYZONE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Suggested settings for a large cluster (about 1000 executors, ~100 TB of
# records). They are not applied by the library; pass them to the session
# builder. Shuffle partitions start high and adaptive execution coalesces
# them to ~256 MB; skewed partitions are split; input splits are 256 MB.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "40000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "40000",
    "spark.sql.session.timeZone": "UTC",
}


def shared_dir(spark: SparkSession, name: str = "tallyzone") -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Reads ``spark.checkpoint.dir`` from the session. Where it is unset, a
    local session (one JVM, tests and bench) gets a temporary folder that
    is registered as its checkpoint folder; any other session is refused,
    since executors could not see such a folder. The folder given out is
    removed when the session's JVM ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallyzone-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{folder}/data"


def materialised(df: DataFrame, name: str = "tallyzone") -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage for what is read more than once. Any executor can read
    it, the planner knows its size, and it goes with the session's other
    scratch folders.
    """
    return counted(df, name)[0]


def counted(df: DataFrame, name: str = "tallyzone") -> tuple[DataFrame, int]:
    """:func:`materialised`, with the number of rows, counted as they are written."""
    path, rows = shared_dir(df.sparkSession, name), Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), rows.get["n"]
