"""The review store as frames, synthesised from events, and the scoring of its findings."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: Scoring weights, in points, and what a finding of a rule is covered by on the same model.
SEVERITY_POINTS = {"critical": 100.0, "high": 60.0, "medium": 30.0, "low": 10.0, "info": 2.0}
CONFIDENCE_FACTOR = {"measured": 1.0, "proven": 0.9, "likely": 0.7, "possible": 0.4}
REACH_POINTS = ((20, 16.0), (5, 13.0), (1, 8.0))
GOVERNED_POINTS, DISMISSAL_POINTS, LEAST_JUDGED, LEAST_RATE, FLOOR = 25.0, 45.0, 2, 0.5, 1.0
COVERED_BY = {"F2001": ("F4002", "F5001", "F5004", "F5005", "F8003", "F9005", "F9007"), "F1001": ("F8002", "F9007")}
#: Fixed values of the synthesised store.
NOW = "2024-01-31 00:00:00"
RULES = ("F1001", "F2001", "F3001", "F4002", "F8002", "F9007", "F6001")
SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("measured", "proven", "likely", "possible")
DISPOSITIONS = ("dismissed", "accepted", "fixed", "deferred")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """The value at a zero-based index; null beyond the last."""
    return F.try_element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def fingerprint(*parts: Column) -> Column:
    """First half of a SHA-256 over the parts, joined by the four characters of an escaped unit separator."""
    return F.substring(F.sha2(F.concat_ws("\\x1f", *parts), 256), 1, 32)


def normalised(note: Column) -> Column:
    return F.trim(F.regexp_replace(note, r"\s+", " "))


class Store:
    """Runs, findings, decisions, measured deltas, grains and model calls."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.events = table(spark, sf_dir, "events")

    @cached_property
    def findings(self) -> DataFrame:
        k = F.col("event_id")
        note = F.concat(F.col("event_type"), F.lit("  moved "), (k % 3).cast("string"))
        rows = self.events.select(
            k.alias("id"), (k % 40 + 1).alias("run_id"), F.concat(F.lit("m"), (F.col("user_id") % 12).cast("string")).alias("model_name"), pick(RULES, k % 7).alias("rule_id"),
            pick(SEVERITIES, k % 11 % 5).alias("severity"), pick(CONFIDENCES, k % 4).alias("confidence"), note.alias("note"), pick(DISPOSITIONS, k % 9).alias("disposition"),
            F.col("ts").alias("created_at"), (k % 23).alias("reach"),
        )
        return rows.withColumn("fingerprint", fingerprint(F.lit("ledger"), F.col("rule_id"), F.col("model_name"), normalised(F.col("note"))))

    @cached_property
    def runs(self) -> DataFrame:
        run = F.col("run_id")
        status = F.when(run % 9 == 0, "failed").when(run % 10 == 0, "queued").when(run % 11 == 0, "running").otherwise("succeeded")
        rows = self.findings.groupBy("run_id").agg(F.max("created_at").alias("created_at"))
        return rows.select(
            run.alias("id"), F.concat(F.lit("p"), (run % 3).cast("string")).alias("project"), status.alias("status"), (run % 2 == 0).alias("executed"), "created_at",
            F.timestamp_add("MINUTE", run, F.col("created_at")).alias("heartbeat_at"), (run + 100).alias("pr_number"), (run * 3 % 17 + 1).alias("models_reviewed"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        """Decisions on findings; every fifth finding was decided twice."""
        judged = self.findings.where("disposition is not null")
        first = judged.select((F.col("id") * 2).alias("id"), F.col("id").alias("finding_id"), "disposition", F.concat(F.lit("u"), (F.col("id") % 5).cast("string")).alias("actor"), F.timestamp_add("HOUR", F.lit(1), F.col("created_at")).alias("at"))
        again = judged.where("id % 5 = 0").select((F.col("id") * 2 + 1).alias("id"), F.col("id").alias("finding_id"), F.lit("accepted").alias("disposition"), F.lit("u9").alias("actor"), F.timestamp_add("HOUR", F.lit(2), F.col("created_at")).alias("at"))
        return first.unionByName(again)

    @cached_property
    def calls(self) -> DataFrame:
        return self.findings.where("id % 3 = 0").select((F.col("id") + 1).alias("id"), "run_id", "fingerprint", pick(("specialist", "supervisor"), F.col("id") % 2).alias("seat"), (F.col("id") % 4 != 0).alias("accepted"))

    @cached_property
    def grains(self) -> DataFrame:
        return self.findings.groupBy("model_name", "run_id").agg((F.count(F.lit(1)).cast("double") / F.count_distinct("rule_id")).alias("rows_per_key"))


def calibrated(severity: Column, confidence: Column) -> Column:
    """Critical only where it is measured."""
    return F.when((severity == "critical") & (confidence != "measured"), "high").otherwise(severity)


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    out = F.lit(None).cast("double")
    for k, v in reversed(values.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def reach_points(reach: Column) -> Column:
    out = F.lit(0.0)
    for least, points in reversed(REACH_POINTS):
        out = F.when(reach >= least, F.lit(points)).otherwise(out)
    return out


def score(severity: Column, confidence: Column, reach: Column, governed: Column, judged: Column, rate: Column) -> Column:
    """Severity times confidence, reach, a bonus for governed models, less for a history of dismissals; never under the floor."""
    penal = (judged >= LEAST_JUDGED) & F.coalesce(rate >= LEAST_RATE, F.lit(False)) & (confidence != "measured")
    total = (
        lookup(SEVERITY_POINTS, severity, 10.0) * lookup(CONFIDENCE_FACTOR, confidence, 0.5) + reach_points(reach) + F.when(governed, F.lit(GOVERNED_POINTS)).otherwise(0.0)
        - F.when(penal, DISMISSAL_POINTS * rate).otherwise(0.0)
    )
    return F.greatest(total, F.lit(FLOOR))
