"""Streams: windows with a watermark for late rows, partition overwrites and history upserts a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import HistoryConfig, first_snapshot, snapshot
from ..operators.incremental import write_partitions


def windowed(stream: DataFrame, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts and sums of ``value`` in tumbling windows; rows later than the watermark are dropped."""
    stamped = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    rows = stamped.groupBy(F.window("__at", width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def run_to_end(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """All that is there, one micro-batch after another."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()


def partition_sink(path: str, partition: list[str]) -> Callable[[DataFrame, int], None]:
    """Each batch replaces the partitions that it holds; a batch that runs again replaces them by the same."""
    return lambda batch, _: write_partitions(batch, path, partition)


def history_sink(spark: SparkSession, root: str, config: HistoryConfig, at: Callable[[int], object]) -> Callable[[DataFrame, int], None]:
    """One snapshot a batch, each a table of its own under the root, so that a batch can run again."""

    def write(batch: DataFrame, epoch: int) -> None:
        stamp = at(epoch)
        out = first_snapshot(batch, config, stamp) if epoch == 0 else snapshot(spark.read.parquet(f"{root}/v{epoch - 1}"), batch, config, stamp)
        out.write.mode("overwrite").parquet(f"{root}/v{epoch}")

    return write
