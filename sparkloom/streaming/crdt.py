"""Replicated state over streams of operations: aggregations in update mode, whose last results are kept by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lww(ops: DataFrame, key: str, value: str) -> DataFrame:
    """The running last write of each key, of a stream or a table (key, stamp, replica, value)."""
    return ops.groupBy(key).agg(F.max(F.struct("stamp", "replica", value)).alias("m")).select(key, f"m.{value}", "m.stamp", "m.replica")


def orset(ops: DataFrame) -> DataFrame:
    """(elem, present, until, latest) of a stream (elem, op, stamp): present while an add is later than every removal.

    A removal observes the adds stamped up to itself, so of all of them the latest decides; late adds with older stamps than a
    removal's stay removed, later ones survive. No watermark: state is two stamps for each element.
    """
    state = ops.groupBy("elem").agg(F.max(F.when(F.col("op") == "add", F.col("stamp"))).alias("latest"), F.max(F.when(F.col("op") == "remove", F.col("stamp"))).alias("until"))
    return state.select("elem", (F.col("latest").isNotNull() & (F.col("until").isNull() | (F.col("latest") > F.col("until")))).alias("present"), "until", "latest")


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream of complete results over all that there is, and keep the last as Parquet."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
