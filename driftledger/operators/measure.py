"""Measuring one table: shape, totals, null rates, keys and grain; each in one pass over the columns it needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..functions.money import total_moved

#: Columns that two builds of the same code write differently; never compared.
IGNORED = (
    "_loaded_at", "loaded_at", "_etl_loaded_at", "_dbt_loaded_at", "dbt_updated_at", "dbt_valid_from", "dbt_valid_to",
    "dbt_scd_id", "_dbt_run_id", "invocation_id", "run_started_at",
)


def shape(df: DataFrame, name: str) -> DataFrame:
    """(table_name, row_count, column_count, numeric_columns); columns come from the schema, rows from one count."""
    numeric = sum(isinstance(f.dataType, NumericType) for f in df.schema)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(numeric).alias("numeric_columns"))


def sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """Totals of all columns in one scan, exact in decimal."""
    return df.agg(*(F.sum(F.col(c).cast("decimal(18,4)")).cast("decimal(38,4)").alias(c) for c in columns))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of nulls of every column in one scan; null for an empty table, whose rate is unknown."""
    n = F.count(F.lit(1))
    return df.agg(*(F.try_divide((n - F.count(c)).cast("double"), F.nullif(n, F.lit(0))).alias(c) for c in columns))


def distinct_keys(keys: list[str]) -> Column:
    """Distinct combinations; one that holds a null counts too."""
    return F.count_distinct(F.struct(*keys))


def grain(df: DataFrame, keys: list[str]) -> DataFrame:
    """(row_count, key_count, null_key_rows, rows_per_key, is_unique) of a candidate key."""
    null_key = F.coalesce(*(F.when(F.col(k).isNull(), F.lit(1)) for k in keys), F.lit(0))
    counted = df.agg(F.count(F.lit(1)).alias("row_count"), distinct_keys(keys).alias("key_count"), F.coalesce(F.sum(null_key), F.lit(0)).cast("long").alias("null_key_rows"))
    per_key = F.try_divide(F.col("row_count").cast("double"), F.nullif("key_count", F.lit(0)))
    return counted.select("*", per_key.alias("rows_per_key"), ((F.col("row_count") == F.col("key_count")) & (F.col("null_key_rows") == 0)).alias("is_unique"))


def schema_frame(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "column string, type string")


def schema_diff(spark: SparkSession, before: StructType, after: StructType) -> DataFrame:
    """(column, change, type_before, type_after) for columns added, removed and retyped."""
    b = schema_frame(spark, before).withColumnRenamed("type", "type_before")
    a = schema_frame(spark, after).withColumnRenamed("type", "type_after")
    change = F.when(F.col("type_before").isNull(), "added").when(F.col("type_after").isNull(), "removed").when(F.col("type_before") != F.col("type_after"), "retyped")
    return b.join(a, "column", "full_outer").withColumn("change", change).where("change is not null").select("column", "change", "type_before", "type_after")


def contract_violations(spark: SparkSession, declared: dict[str, str], produced: StructType) -> DataFrame:
    """(column, problem) for declared columns that are missing or of another type."""
    have = {f.name: f.dataType.simpleString() for f in produced}
    rows = [(c, "missing" if c not in have else f"declared {t}, produced {have[c]}") for c, t in declared.items() if have.get(c) != t]
    return spark.createDataFrame(rows, "column string, problem string")


@dataclass(frozen=True)
class Delta:
    """What is measured of a model in both builds: long rows (model, metric, column, before, after)."""

    model: str
    keys: tuple[str, ...]
    amounts: tuple[str, ...]


def long_delta(base: DataFrame, head: DataFrame, delta: Delta) -> DataFrame:
    """(model, metric, column_name, before, after) of row count, totals and null rates, one scan a side."""

    def one(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1))
        values = [("rows", "*", n.cast("decimal(38,4)"))]
        values += [("sum", c, F.sum(F.col(c).cast("decimal(28,4)")).cast("decimal(38,4)")) for c in delta.amounts]
        values += [("nulls", c, (n - F.count(c)).cast("decimal(38,4)")) for c in (*delta.keys, *delta.amounts)]
        row = df.agg(*(v.alias(f"v{k}") for k, (_, _, v) in enumerate(values)))
        long = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(c).alias("column_name"), F.col(f"v{k}").alias(side)) for k, (m, c, _) in enumerate(values))))
        return row.select(long.alias("x")).select("x.*")

    both = one(base, "before").join(one(head, "after"), ["metric", "column_name"], "full_outer")
    return both.select(F.lit(delta.model).alias("model"), "metric", "column_name", "before", "after")


def material(long: DataFrame) -> DataFrame:
    """(model, is_material, moved): whether rows, totals or null counts moved, and how many of them."""
    moved = F.when(F.col("metric") == "sum", total_moved(F.col("before"), F.col("after"))).otherwise(~F.col("before").eqNullSafe(F.col("after")))
    return long.groupBy("model").agg(F.bool_or(moved).alias("is_material"), F.count_if(moved).alias("moved"))
