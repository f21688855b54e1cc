"""Session helpers shared by every operator: tables, scratch space, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Plans whose optimized size is at most this many bytes may be broadcast by :func:`small`.
BROADCAST_BYTES = 16 << 20


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A single-JVM session with the settings that the tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("pageloom")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Where the setting is unset a local session (tests, bench) gets a folder of its own, removed when the process ends; on
    a cluster it is an error, since a folder of one machine is lost with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = got.get() if got.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="pageloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        root = "file://" + made
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/pageloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared scratch folder and read back (survives lost executors)."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: How much larger rows are in memory than in a compressed Parquet file.
UNPACKED = 10


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimated size, unpacked, is within ``limit``; else leave the join to AQE."""
    return F.broadcast(df) if estimated_bytes(df) * UNPACKED <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores, dealt out to all of them; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
