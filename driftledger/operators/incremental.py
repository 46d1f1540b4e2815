"""Incremental writes, as pure functions of target and batch, and as writes to partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Both, nothing checked: a batch that is processed twice is there twice."""
    return target.unionByName(batch)


def delete_insert(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The target without the batch's keys, and the batch."""
    return target.join(batch.select(*key).distinct(), key, "left_anti").unionByName(batch)


def merge(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Matched rows take the batch's values, others are inserted. A batch that repeats a key is refused when it runs."""
    columns = [c for c in target.columns if c not in key]
    single = batch.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), *(F.any_value(c).alias(f"s_{c}") for c in columns))
    refuse = F.when(F.col("__n") > 1, F.raise_error(F.lit("merge: a key matches several rows of the batch"))).otherwise(F.col("__n"))
    joined = target.join(single.withColumn("__n", refuse), key, "full_outer")
    return joined.select(*key, *(F.when(F.col("__n").isNotNull(), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in columns))


def overwrite_partitions(target: DataFrame, batch: DataFrame, partition: list[str]) -> DataFrame:
    """Every partition that the batch holds replaces the target's."""
    return target.join(batch.select(*partition).distinct(), partition, "left_anti").unionByName(batch)


def write_partitions(batch: DataFrame, path: str, partition: list[str]) -> None:
    """The same on a stored table: only the partitions that are written are replaced."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def lookback(source: DataFrame, target: DataFrame, period: str, months: int) -> DataFrame:
    """Rows of the source from so many months before the target's latest period; all for an empty target."""
    since: Column = F.add_months(F.max(period), -months)
    bound = target.agg(F.coalesce(since, F.lit("0001-01-01").cast("date")).alias("__since"))
    return source.crossJoin(F.broadcast(bound)).where(F.col(period) >= F.col("__since")).drop("__since")
