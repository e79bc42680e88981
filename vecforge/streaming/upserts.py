"""Structured Streaming into a vector table. An addition: exact search over what a stream has brought so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame) -> DataFrame:
    """The last change (greatest seq) of each id; a pre-aggregated maximum."""
    last = changes.groupBy("id").agg(F.max(F.struct("seq", "v", "deleted")).alias("c"))
    return last.select("id", "c.v", "c.deleted", "c.seq")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str):
    """Appends every micro-batch's last changes under its own batch folder; a retried batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current(changes: DataFrame) -> DataFrame:
    """The live rows of all batches written."""
    return latest(changes).where(~F.col("deleted")).select("id", "v")


def decayed_heat(stream: DataFrame, minutes: int = 5) -> DataFrame:
    """Accesses of each block in tumbling windows; accesses later than the watermark are left out."""
    return stream.withWatermark("ts", f"{minutes} minutes").groupBy(F.window("ts", f"{minutes} minutes"), "block_id").agg(F.count("*").alias("accesses"))


def sessions(trace: DataFrame, gap_seconds: int) -> DataFrame:
    """Numbers of each user's sessions, runs of accesses without a longer gap."""
    w = Window.partitionBy("user_id").orderBy("ts", "seq")
    new = F.coalesce((F.col("ts").cast("double") - F.lag("ts").over(w).cast("double") > gap_seconds).cast("int"), F.lit(1))
    return trace.withColumn("new", new).withColumn("session", F.sum("new").over(w)).drop("new")
