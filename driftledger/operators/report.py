"""Reports of one review, and writing to the store. A review has some hundreds of findings; its documents are one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redaction

#: What may leave in a redacted report as it is, and what only as a token.
OPEN, TOKENS = ("rule_id", "severity", "confidence"), ("model_name",)


def level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def json_report(findings: DataFrame, run_id: int, blind_spots: tuple[str, ...]) -> DataFrame:
    """(report): the run's findings as one JSON document; what could not be looked at is always part of it."""
    own = findings.where(F.col("run_id") == run_id)
    item = F.struct("rule_id", "severity", "confidence", "model_name", "note")
    listed = own.agg(F.array_sort(F.collect_list(item)).alias("findings"))
    spots = F.array(*map(F.lit, blind_spots)) if blind_spots else F.array().cast("array<string>")
    return listed.select(F.to_json(F.struct(F.lit(run_id).alias("run"), "findings", spots.alias("blind_spots"))).alias("report"))


def sarif(findings: DataFrame, run_id: int) -> DataFrame:
    """(report): the same as static-analysis results, dismissed ones as suppressed."""
    own = findings.where(F.col("run_id") == run_id)
    suppressed = F.when(F.col("disposition") == "dismissed", F.array(F.struct(F.lit("external").alias("kind"))))
    result = F.struct(F.col("rule_id").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.col("note").alias("text")).alias("message"), suppressed.alias("suppressions"))
    run = F.struct(F.struct(F.struct(F.lit("driftledger").alias("name")).alias("driver")).alias("tool"), F.array_sort(F.collect_list(result)).alias("results"))
    return own.agg(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("report"))


def markdown(ranked: DataFrame, most: int | None = None) -> str:
    """The findings of a ranked frame as a table, or the first so many and a line that says how many follow.

    The one report that is made on the driver, row by row.
    """
    ordered = ranked.orderBy("rank")
    rows = (ordered if most is None else ordered.limit(most)).select("rank", "rule_id", "severity", "model_name", "note").toLocalIterator()
    lines = ["| rank | rule | severity | model | note |", "|-|-|-|-|-|"]
    lines += ["| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows]
    more = ranked.count() - most if most is not None else 0
    return "\n".join([*lines, *([f"and {more} more"] if more > 0 else [])])


def redacted(findings: DataFrame, salt: str) -> DataFrame:
    """Only listed columns leave, names as tokens of this salt."""
    return findings.select(*OPEN, *(redaction(salt, F.col(c)).alias(c) for c in TOKENS))


def save(findings: DataFrame, path: str) -> None:
    """Write runs' findings to the store, one partition a run; a run that is written again replaces its own."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def drop_run_databases(spark, token: str) -> list[str]:
    """Drop the databases of one run: only names that carry its token, and never without one."""
    if len(token) < 6:
        raise ValueError("a run's token has six characters at least")
    names = [d.name for d in spark.catalog.listDatabases() if d.name.endswith(f"_{token}")]
    for name in names:
        spark.sql(f"drop database `{name}` cascade")
    return names
