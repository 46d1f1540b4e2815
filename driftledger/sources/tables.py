"""Input tables, seeds and project manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seed(spark: SparkSession, path: str, schema: StructType | str, most: int | None = None) -> DataFrame:
    """A CSV seed with declared types; short rows are padded with nulls, ``most`` caps the rows of a preview."""
    df = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")
    return df.limit(most) if most is not None else df


_NODE = "struct<name:string,resource_type:string,original_file_path:string,raw_code:string,compiled_code:string,tags:array<string>,config:struct<materialized:string,incremental_strategy:string,unique_key:array<string>>,depends_on:struct<nodes:array<string>>,attached_node:string,test_metadata:struct<name:string,kwargs:struct<column_name:string>>>"


def manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes, dependency edges and declared key tests of a compiled project's manifest file."""
    raw = spark.read.schema(f"nodes map<string,{_NODE}>").json(path, multiLine=True)
    nodes = raw.select(F.explode("nodes").alias("id", "n")).select("id", "n.*")
    models = nodes.where(F.col("resource_type").isin("model", "seed", "snapshot"))
    edges = models.select(F.explode("depends_on.nodes").alias("parent"), F.col("id").alias("child"))
    tests = nodes.where("resource_type = 'test'").select(
        F.coalesce("attached_node", F.element_at("depends_on.nodes", 1)).alias("model"),
        F.col("test_metadata.name").alias("test"),
        F.col("test_metadata.kwargs.column_name").alias("column"),
    )
    return {"nodes": models, "edges": edges, "tests": tests}


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """(name, status) of the models and seeds of one build."""
    raw = spark.read.schema("results array<struct<unique_id:string,status:string>>").json(path, multiLine=True)
    rows = raw.select(F.explode("results").alias("r")).select("r.*")
    kept = rows.where(F.substring_index("unique_id", ".", 1).isin("model", "seed", "snapshot"))
    return kept.select(F.substring_index("unique_id", ".", -1).alias("name"), "status")
