"""Structured Streaming: daily quotas, idempotent delivery and per-origin throttling over file streams.

Every query runs with ``availableNow``: a bounded catch-up that keeps its progress in a checkpoint of the shared
scratch folder, so a lost executor or a restart repeats no result.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import scratch_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the event files, event time as a zoned timestamp (watermarks need one)."""
    schema = spark.read.parquet(path).schema
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        folder, name = os.path.split(local)
        stream = spark.readStream.schema(schema).option("pathGlobFilter", glob.escape(name)).parquet(folder)
    else:
        stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def caught_up(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there and return what it wrote."""
    spark = stream.sparkSession
    at = scratch_dir(spark)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{at}/out")

    def keep(batch: DataFrame, n: int) -> None:
        # Complete and update results replace the former ones; a repeated batch overwrites itself.
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n:09d}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").drop("batch") if mode == "complete" else out


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """event_type, day, n: tumbling day windows with two days for late events."""
    s = event_stream(spark, path).withWatermark("ts", "2 days").groupBy("event_type", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    out = caught_up(s.select("event_type", F.col("window.start").alias("day"), "n"), "complete")
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


def distinct_events(spark: SparkSession, path: str) -> DataFrame:
    """Each event_id once, however often it is delivered within the watermark."""
    s = event_stream(spark, path)
    twice = s.unionByName(s).withWatermark("ts", "400 days").dropDuplicatesWithinWatermark(["event_id"])
    return caught_up(twice.select("event_id", "user_id", "event_type"))


def throttled(spark: SparkSession, path: str, delay: int) -> DataFrame:
    """user_id, requests, next_allowed: keyed state of an origin's last request; next_allowed is ``delay`` seconds later."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf["at"].max()))
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "requests": [n], "next_allowed": [last + delay]})

    s = event_stream(spark, path).select("user_id", F.unix_timestamp("ts").alias("at"))
    out = s.groupBy("user_id").applyInPandasWithState(fold, "user_id long, requests long, next_allowed long", "requests long, last long", "update", GroupStateTimeout.NoTimeout)
    rows = caught_up(out, "update")
    best = F.max(F.struct("requests", "next_allowed")).alias("b")
    return rows.groupBy("user_id").agg(best).select("user_id", "b.requests", "b.next_allowed")
