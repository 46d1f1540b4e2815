"""Slowly changing history: versions of rows with the time from which and until which each held."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HistoryConfig:
    """``strategy``: timestamp (a newer ``updated_at``) or check (any of ``checked`` differs; empty: all columns).

    ``deletes``: ignore, invalidate (close the version) or new_record (close it and write a deletion).
    """

    key: tuple[str, ...]
    strategy: str
    updated_at: str | None = None
    checked: tuple[str, ...] = ()
    deletes: str = "ignore"


META = ("scd_id", "valid_from", "valid_to", "is_deleted")


def scd_id(key: tuple[str, ...], stamp: Column) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key), stamp.cast("string")))


def first_snapshot(source: DataFrame, config: HistoryConfig, at: Column) -> DataFrame:
    stamp = F.col(config.updated_at) if config.strategy == "timestamp" else at
    kept = source.withColumn("valid_from", stamp).withColumn("valid_to", F.lit(None).cast(source.select(stamp).schema[0].dataType))
    return kept.withColumn("scd_id", scd_id(config.key, F.col("valid_from"))).withColumn("is_deleted", F.lit(False))


def snapshot(history: DataFrame, source: DataFrame, config: HistoryConfig, at: Column) -> DataFrame:
    """The history after one more run: one full outer join of all versions with the source, which only open ones can meet.

    The source must hold each key once. Every joined row gives the versions that follow from it, so that both sides are
    read once a run however many runs are chained. Closed versions pass through untouched.
    """
    columns, key = list(source.columns), list(config.key)
    open_ = F.col("valid_to").isNull() & ~F.col("is_deleted")
    old = history.select(*columns, "valid_from", "valid_to", "scd_id", "is_deleted", open_.alias("is_open"))
    new = source.select(*(F.col(c).alias(f"n_{c}") for c in columns), F.lit(True).alias("n_open"))
    joined = old.join(new, [*(F.col(k) == F.col(f"n_{k}") for k in key), F.col("is_open") == F.col("n_open")], "full_outer")
    known, there = F.col("is_open").isNotNull(), F.col("n_open").isNotNull()
    if config.strategy == "timestamp":
        changed, stamp = F.col(f"n_{config.updated_at}") > F.col(config.updated_at), F.col(f"n_{config.updated_at}")
    else:
        checked = [c for c in (config.checked or tuple(columns)) if c not in key]
        changed, stamp = ~F.struct(*checked).eqNullSafe(F.struct(*(F.col(f"n_{c}").alias(c) for c in checked))), at
    moves = there & known & F.coalesce(changed, F.lit(False))
    ends = known & F.col("is_open") & ~there & F.lit(config.deletes != "ignore")
    until = history.schema["valid_to"].dataType

    def version(prefix: str, since: Column, to: Column, id_: Column, deleted: Column) -> Column:
        fields = [F.col(f"{prefix}{c}").alias(c) for c in columns]
        return F.struct(*fields, since.cast(until).alias("valid_from"), to.cast(until).alias("valid_to"), id_.alias("scd_id"), deleted.alias("is_deleted"))

    never = F.lit(None)
    made = [
        # what was there, closed where it changed or went away
        F.when(known, version("", F.col("valid_from"), F.when(moves, stamp).when(ends, at).otherwise(F.col("valid_to")), F.col("scd_id"), F.col("is_deleted"))),
        # new keys and new versions
        F.when(there & (~known | moves), version("n_", stamp, never, scd_id(tuple(f"n_{k}" for k in key), stamp), F.lit(False))),
    ]
    if config.deletes == "new_record":
        made.append(F.when(ends, version("", at, never, scd_id(config.key, at), F.lit(True))))
    return joined.select(F.explode(F.filter(F.array(*made), lambda v: v.isNotNull())).alias("v")).select("v.*")


def current(history: DataFrame) -> DataFrame:
    return history.where("valid_to is null and not is_deleted")


def as_of(facts: DataFrame, history: DataFrame, key: str, day: str) -> DataFrame:
    """Each fact with the version that held on its day: equality on the key, then the interval."""
    condition = (facts[key] == history[key]) & (history["valid_from"] <= facts[day]) & (history["valid_to"].isNull() | (facts[day] < history["valid_to"]))
    return facts.join(history, condition)


def from_changelog(changes: DataFrame, key: list[str], at: str) -> DataFrame:
    """Versions out of a log of changes: each holds until the next one of its key."""
    return changes.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(Window.partitionBy(*key).orderBy(at)))
