"""The key of every model from the best source that there is, and its way through models that keep rows as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import settled

#: Where a key may be known from, the surest first.
SOURCES = ("measured", "structural", "config", "declared", "propagated", "heuristic", "unknown")


def rank(source: str):
    return F.array_position(F.array(*map(F.lit, SOURCES)), F.col(source))


def best(known: DataFrame) -> DataFrame:
    """(name, key, source) of the surest of several claims (name, key, source) on each model; the smallest key breaks ties."""
    return known.groupBy("name").agg(F.min(F.struct(rank("source").alias("at"), "key", "source")).alias("b")).select("name", "b.key", "b.source")


def resolve(names: DataFrame, claims: DataFrame, passes: DataFrame) -> DataFrame:
    """(name, key, source) of all models.

    ``claims`` holds what is known of single models; ``passes`` (parent, child) the models that take the rows of one other
    model as they are, with its key among their columns. A key goes along these as far as no surer claim stands, however
    long the way; what is only guessed from names is neither handed on nor kept where a key arrives.
    """
    passes = settled(passes.select("parent", "child").distinct())
    sure = best(claims.where(rank("source") <= rank_of("declared")))
    step = found = settled(sure)
    while not step.isEmpty():
        handed = passes.join(step.select(F.col("name").alias("parent"), "key"), "parent").groupBy(F.col("child").alias("name")).agg(F.min("key").alias("key"))
        step = settled(handed.join(found.select("name"), "name", "left_anti").withColumn("source", F.lit("propagated")).select("name", "key", "source"))
        found = found.unionByName(step)
    rest = best(claims.where("source = 'heuristic'")).join(found.select("name"), "name", "left_anti")
    found = found.unionByName(rest)
    unknown = names.select("name").distinct().join(found.select("name"), "name", "left_anti")
    return found.unionByName(unknown.select("name", F.lit(None).cast("string").alias("key"), F.lit("unknown").alias("source")))


def rank_of(source: str) -> int:
    return SOURCES.index(source) + 1
