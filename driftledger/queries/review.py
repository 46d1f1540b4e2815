"""Review history, dashboard, scoring and corpus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import is_governed, marks
from ..operators import review as ops
from ..operators.review import Store
from ..sources.tables import table
from . import query
from .graph import E as EDGES_SQL
from .graph import edges
from .review_sql import store



def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def blocking(open_only: bool = True):
    grave = F.col("severity").isin("critical", "high")
    return grave & (F.col("disposition").isNull() | (F.col("disposition") == "deferred")) if open_only else grave


_BLOCKING = "severity in ('critical', 'high') and (disposition is null or disposition = 'deferred')"


@query("finding_fingerprint", store("select id, fingerprint from findings"))
def finding_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).findings.select("id", "fingerprint")


@query("prior_occurrences", store("select f.id, count(p.id) as prior from findings f left join findings p on f.fingerprint = p.fingerprint and p.run_id < f.run_id group by f.id"))
def prior_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier findings of the same fingerprint: running counts a fingerprint and run, no self join."""
    findings = Store(spark, sf_dir).findings
    per = findings.groupBy("fingerprint", "run_id").agg(n())
    earlier = Window.partitionBy("fingerprint").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("fingerprint", "run_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("prior"))
    return findings.join(per, ["fingerprint", "run_id"]).select("id", "prior")


_RATE = "count_if(disposition = 'dismissed') as dismissed, count(disposition) as judged, cast(count_if(disposition = 'dismissed') as double) / nullif(count(disposition), 0) as rate"


def _rates(df: DataFrame, *by: str) -> DataFrame:
    dismissed, judged = F.count_if(F.col("disposition") == "dismissed"), F.count("disposition")
    return df.groupBy(*by).agg(dismissed.alias("dismissed"), judged.alias("judged"), F.try_divide(dismissed.cast("double"), F.nullif(judged, F.lit(0))).alias("rate"))


@query("dismissal_rate", store(f"select rule_id, {_RATE} from findings group by rule_id"))
def dismissal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(Store(spark, sf_dir).findings, "rule_id")


@query("history_counts", store("select fingerprint, count(*) as occurrences, " + ", ".join(f"count_if(disposition = '{d}') as {d}" for d in ops.DISPOSITIONS) + ", max_by(note, id) as last_note from findings group by fingerprint"))
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [F.count_if(F.col("disposition") == d).alias(d) for d in ops.DISPOSITIONS]
    return Store(spark, sf_dir).findings.groupBy("fingerprint").agg(n("occurrences"), *each, F.max_by("note", "id").alias("last_note"))


_PRECEDENT = """select finding_id, precedent_id, cast(rank as integer) as rank from (select f.id as finding_id, p.id as precedent_id, row_number() over (partition by f.id order by p.model_name = f.model_name desc, p.created_at desc, p.id desc) as rank
from findings f join (select * from (select *, row_number() over (partition by rule_id order by created_at desc, id desc) as newest from findings where disposition is not null) where newest <= 200) p on f.rule_id = p.rule_id and f.run_id <> p.run_id) where rank <= 3"""


@query("precedent_topk", store(_PRECEDENT))
def precedent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each finding three of the 200 newest judged ones of its rule, from other runs: of its model first, newest first.

    A rule's pool is one array of at most 200, so that a finding meets it without a row for each pair.
    """
    findings = Store(spark, sf_dir).findings
    newest = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    judged = findings.where("disposition is not null").withColumn("newest", newest).where("newest <= 200")
    pool = judged.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("newest", "id", "run_id", F.col("model_name").alias("model")))).alias("pool"))
    rows = findings.select("rule_id", F.col("id").alias("finding_id"), "run_id", "model_name").join(pool, "rule_id")
    others = F.filter("pool", lambda p: p["run_id"] != F.col("run_id"))
    same = F.filter(others, lambda p: p["model"] == F.col("model_name"))
    rest = F.filter(others, lambda p: p["model"] != F.col("model_name"))
    best = F.slice(F.concat(F.slice(same, 1, 3), F.slice(rest, 1, 3)), 1, 3)
    return rows.select("finding_id", F.posexplode(best).alias("at", "p")).select("finding_id", F.col("p.id").alias("precedent_id"), (F.col("at") + 1).alias("rank"))


@query("latest_disposition", store("select finding_id, disposition, actor from (select *, row_number() over (partition by finding_id order by decided_at desc, id desc) as rn from decisions) where rn = 1"))
def latest_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("finding_id").orderBy(F.col("at").desc(), F.col("id").desc())
    return Store(spark, sf_dir).decisions.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("finding_id", "disposition", "actor")


@query("export_calls_latest_judgement", store("select c.id, c.seat, c.accepted, j.disposition from calls c left join (select fingerprint, disposition from (select f.fingerprint, d.disposition, row_number() over (partition by f.fingerprint order by d.decided_at desc, d.id desc) as rn from decisions d join findings f on d.finding_id = f.id) where rn = 1) j on c.fingerprint = j.fingerprint"))
def export_calls_latest_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    judged = s.decisions.join(s.findings.select(F.col("id").alias("finding_id"), "fingerprint"), "finding_id")
    latest = judged.groupBy("fingerprint").agg(F.max_by("disposition", F.struct("at", "id")).alias("disposition"))
    return s.calls.join(latest, "fingerprint", "left").select("id", "seat", "accepted", "disposition")


_STALE = f"(status = 'queued' or (status = 'running' and heartbeat_at < timestamp '{ops.NOW}' - interval 10 minute))"


@query("claimable_runs", store(f"select id, project, status from runs where {_STALE} and not executed or {_STALE} and id % 4 = 0 order by created_at, id limit 3"))
def claimable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued or stale runs that a worker without execution, or with it every fourth, may claim; oldest first."""
    stale = F.col("heartbeat_at") < F.lit(ops.NOW).cast("timestamp_ntz") - F.expr("interval 10 minutes")
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & stale)
    rows = Store(spark, sf_dir).runs.where(free & (~F.col("executed") | (F.col("id") % 4 == 0)))
    return rows.orderBy("created_at", "id").limit(3).select("id", "project", "status")


@query("latest_run", store("select project, id from (select *, row_number() over (partition by project order by created_at desc, id desc) as rn from runs where status = 'succeeded') where rn = 1"))
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).runs.where("status = 'succeeded'").groupBy("project").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("known_models", store(f"select model_name as name from findings union select model_name from grains union select child from {EDGES_SQL}"))
def known_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return s.findings.select(F.col("model_name").alias("name")).union(s.grains.select("model_name")).union(edges(spark, sf_dir).select("child")).distinct()


_VERDICT = f"case when count_if(severity in ('critical', 'high') and (disposition is null or disposition = 'deferred')) > 0 then 'blocking' when count_if(disposition is null) > 0 then 'review' else 'clear' end"


def _verdict():
    return F.when(F.count_if(blocking()) > 0, "blocking").when(F.count_if(F.col("disposition").isNull()) > 0, "review").otherwise("clear")


@query("run_verdict", store(f"select run_id, {_VERDICT} as verdict from findings group by run_id"))
def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).findings.groupBy("run_id").agg(_verdict().alias("verdict"))


_COUNTS = ", ".join(f"count_if(severity = '{s}') as {s}" for s in ops.SEVERITIES)


@query("pull_request_rows", store(f"select r.pr_number, r.status, {_COUNTS}, count_if(disposition is null) as open_findings, bool_or(rule_id = 'F9007') as restates from findings f join runs r on f.run_id = r.id group by r.pr_number, r.status"))
def pull_request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    joined = s.findings.join(s.runs.select(F.col("id").alias("run_id"), "pr_number", "status"), "run_id")
    each = [F.count_if(F.col("severity") == x).alias(x) for x in ops.SEVERITIES]
    return joined.groupBy("pr_number", "status").agg(*each, F.count_if(F.col("disposition").isNull()).alias("open_findings"), F.bool_or(F.col("rule_id") == "F9007").alias("restates"))


@query("overview_kpis", store(f"select (select count(*) from runs where status = 'succeeded') as runs, count(*) as findings, count_if({_BLOCKING}) as blocking, count(disposition) as judged, count(distinct model_name) as models, cast(count_if(disposition = 'dismissed') as double) / nullif(count(disposition), 0) as dismissal_rate from findings where run_id in (select id from runs where status = 'succeeded')"))
def overview_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    done = s.runs.where("status = 'succeeded'")
    rows = s.findings.join(done.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    figures = rows.agg(
        n("findings"), F.count_if(blocking()).alias("blocking"), F.count("disposition").alias("judged"), F.count_distinct("model_name").alias("models"),
        F.try_divide(F.count_if(F.col("disposition") == "dismissed").cast("double"), F.nullif(F.count("disposition"), F.lit(0))).alias("dismissal_rate"),
    )
    return done.agg(n("runs")).crossJoin(figures)


@query("daily_trend", store(f"select day, severity, count(f.id) as n from (select cast(unnest(generate_series(timestamp '{ops.NOW}' - interval 29 day, timestamp '{ops.NOW}', interval 1 day)) as date) as day) d cross join (select unnest(['critical','high','medium','low','info']) as severity) s left join findings f on cast(f.created_at as date) = d.day and f.severity = s.severity group by day, s.severity".replace("select day, severity", "select day, s.severity")))
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days by five severities, zeros included; the calendar has 150 rows."""
    days = F.sequence(F.date_sub(F.lit(ops.NOW).cast("date"), 29), F.lit(ops.NOW).cast("date"))
    spine = spark.range(1).select(F.explode(days).alias("day")).select("day", F.explode(F.array(*map(F.lit, ops.SEVERITIES))).alias("severity"))
    counted = Store(spark, sf_dir).findings.groupBy(F.col("created_at").cast("date").alias("day"), "severity").agg(n())
    return spine.join(counted, ["day", "severity"], "left").select("day", "severity", F.coalesce("n", F.lit(0)).alias("n"))


@query("recent_decisions", store("select d.id, d.disposition, f.rule_id, r.project from decisions d join findings f on d.finding_id = f.id join runs r on f.run_id = r.id order by d.decided_at desc, d.id desc limit 10"))
def recent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    f, r = s.findings.select(F.col("id").alias("finding_id"), "rule_id", "run_id"), s.runs.select(F.col("id").alias("run_id"), "project")
    joined = s.decisions.join(f, "finding_id").join(r, "run_id")
    return joined.orderBy(F.col("at").desc(), F.col("id").desc()).limit(10).select("id", "disposition", "rule_id", "project")


@query("blocking_runs", store(f"select count(distinct run_id) as blocking_runs from findings where {_BLOCKING} and run_id in (select id from runs where status = 'succeeded')"))
def blocking_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    done = s.runs.where("status = 'succeeded'").select(F.col("id").alias("run_id"))
    return s.findings.where(blocking()).join(done, "run_id", "left_semi").agg(F.count_distinct("run_id").alias("blocking_runs"))


@query("findings_per_run", store("select run_id, count(*) as n from findings group by run_id"))
def findings_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).findings.groupBy("run_id").agg(n())


@query("grain_history", store("select model_name, run_id, rows_per_key from (select *, row_number() over (partition by model_name order by run_id desc) as rn from grains) where rn <= 5"))
def grain_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("model_name").orderBy(F.col("run_id").desc())
    return Store(spark, sf_dir).grains.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("model_name", "run_id", "rows_per_key")


@query("backtest_summary", store("select count(*) as changes, quantile_cont(n, 0.5) as median_findings, max(n) as most_findings, count_if(grave > 0) as with_grave, cast(sum(n) as bigint) as findings from (select run_id, count(*) as n, count_if(severity in ('critical', 'high')) as grave from findings group by run_id)"))
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = Store(spark, sf_dir).findings.groupBy("run_id").agg(n(), F.count_if(blocking(False)).alias("grave"))
    return per.agg(n("changes"), F.percentile("n", 0.5).alias("median_findings"), F.max("n").alias("most_findings"), F.count_if(F.col("grave") > 0).alias("with_grave"), F.sum("n").alias("findings"))


@query("top_rules", store("select rule_id, count(*) as n from findings group by rule_id order by n desc, rule_id limit 8"))
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).findings.groupBy("rule_id").agg(n()).orderBy(F.col("n").desc(), "rule_id").limit(8)


@query("needs_attention", store(f"select r.id, count(*) as n, cast(date_diff('hour', r.created_at, timestamp '{ops.NOW}') as bigint) as waiting_hours from findings f join runs r on f.run_id = r.id where {_BLOCKING} and r.status = 'succeeded' group by r.id, r.created_at order by r.created_at, r.id limit 6".replace("date_diff('hour', r.created_at, timestamp '" + ops.NOW + "')", f"floor(epoch(timestamp '{ops.NOW}' - r.created_at) / 3600)")))
def needs_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with blocking findings that wait the longest."""
    s = Store(spark, sf_dir)
    runs = s.runs.where("status = 'succeeded'").select(F.col("id").alias("run_id"), F.col("created_at").alias("since"))
    rows = s.findings.where(blocking()).join(runs, "run_id").groupBy("run_id", "since").agg(n())
    hours = F.timestamp_diff("HOUR", F.col("since"), F.lit(ops.NOW).cast("timestamp_ntz"))
    return rows.orderBy("since", "run_id").limit(6).select(F.col("run_id").alias("id"), "n", hours.alias("waiting_hours"))


@query("activity_feed", store("select kind, id from (select * from (select 'review' as kind, id, created_at as happened from runs order by created_at desc, id desc limit 12) union all select * from (select 'decision' as kind, id, decided_at from decisions order by decided_at desc, id desc limit 12)) order by happened desc, kind, id desc limit 12"))
def activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    newest = lambda df, kind, at: df.orderBy(F.col(at).desc(), F.col("id").desc()).limit(12).select(F.lit(kind).alias("kind"), "id", F.col(at).alias("at"))
    feed = newest(s.runs, "review", "created_at").unionByName(newest(s.decisions, "decision", "at"))
    return feed.orderBy(F.col("at").desc(), "kind", F.col("id").desc()).limit(12).select("kind", "id")


@query("period_over_period", store(" union all ".join(f"select {d} as days, count_if(created_at >= timestamp '{ops.NOW}' - interval {d} day) as now_count, count_if(created_at < timestamp '{ops.NOW}' - interval {d} day and created_at >= timestamp '{ops.NOW}' - interval {2 * d} day) as prior_count from findings" for d in (7, 14))))
def period_over_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in a window and in the one before; both windows from one scan."""
    ago = lambda d: F.lit(ops.NOW).cast("timestamp_ntz") - F.expr(f"interval {d} days")
    at = F.col("created_at")
    row = Store(spark, sf_dir).findings.agg(*(F.struct(F.lit(d).alias("days"), F.count_if(at >= ago(d)).alias("now_count"), F.count_if((at < ago(d)) & (at >= ago(2 * d))).alias("prior_count")).alias(f"d{d}") for d in (7, 14)))
    return row.select(F.inline(F.array("d7", "d14")))


@query("report_findings_flat", store("select run_id, rule_id, severity, count(*) as n, count(distinct model_name) as models, count_if(disposition is null) as open_findings from findings group by run_id, rule_id, severity"))
def report_findings_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Store(spark, sf_dir).findings
    return rows.groupBy("run_id", "rule_id", "severity").agg(n(), F.count_distinct("model_name").alias("models"), F.count_if(F.col("disposition").isNull()).alias("open_findings"))


_SEVERITY_RANK = "list_position(['critical','high','medium','low','info'], severity)"
_CONFIDENCE_RANK = "list_position(['measured','proven','likely','possible'], confidence)"


@query("report_rank", store(f"select run_id, id, cast(row_number() over (partition by run_id order by {_SEVERITY_RANK}, reach desc, {_CONFIDENCE_RANK}, id) as integer) as rank from findings"))
def report_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every finding in its run's report."""
    place = lambda values, c: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    order = [place(ops.SEVERITIES, "severity"), F.col("reach").desc(), place(ops.CONFIDENCES, "confidence"), F.col("id")]
    return Store(spark, sf_dir).findings.select("run_id", "id", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).alias("rank"))


@query("sarif_levels", store("select case when severity in ('critical', 'high') then 'error' when severity = 'medium' then 'warning' else 'note' end as level, count(*) as n, count_if(disposition = 'dismissed') as suppressed from findings group by 1"))
def sarif_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(blocking(False), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    return Store(spark, sf_dir).findings.groupBy(level.alias("level")).agg(n(), F.count_if(F.col("disposition") == "dismissed").alias("suppressed"))


_CALIBRATED = "case when severity = 'critical' and confidence <> 'measured' then 'high' else severity end"
_SCORED = f"""scored as (select f.*, greatest(1.0, case s when 'critical' then 100.0 when 'high' then 60.0 when 'medium' then 30.0 when 'low' then 10.0 else 2.0 end * case confidence when 'measured' then 1.0 when 'proven' then 0.9 when 'likely' then 0.7 else 0.4 end
 + case when reach >= 20 then 16.0 when reach >= 5 then 13.0 when reach >= 1 then 8.0 else 0.0 end + case when model_name in ('m1', 'm2') then 25.0 else 0.0 end - case when judged >= 2 and rate >= 0.5 and confidence <> 'measured' then 45.0 * rate else 0.0 end) as score
 from (select f.*, {_CALIBRATED} as s, h.judged, h.rate from findings f join (select fingerprint, {_RATE} from findings group by fingerprint) h on f.fingerprint = h.fingerprint) f)"""


@query("triage_calibrated", store(f"select id, {_CALIBRATED} as severity from findings"))
def triage_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).findings.select("id", ops.calibrated(F.col("severity"), F.col("confidence")).alias("severity"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = Store(spark, sf_dir).findings
    rows = findings.join(_rates(findings, "fingerprint"), "fingerprint")
    governed = F.col("model_name").isin("m1", "m2")
    severity = ops.calibrated(F.col("severity"), F.col("confidence"))
    return rows.withColumn("score", ops.score(severity, F.col("confidence"), F.col("reach"), governed, F.col("judged"), F.col("rate")))


@query("triage_scored", store(f"select * from (with {_SCORED} select id, cast(round(score, 4) as decimal(10,4)) as score from scored)"))
def triage_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", F.round("score", 4).cast("decimal(10,4)").alias("score"))


_COVER = "case rule_id when 'F2001' then (select min(o.rule_id) from scored o where o.run_id = s.run_id and o.model_name = s.model_name and o.rule_id in ('F4002','F5001','F5004','F5005','F8003','F9005','F9007')) when 'F1001' then (select min(o.rule_id) from scored o where o.run_id = s.run_id and o.model_name = s.model_name and o.rule_id in ('F8002','F9007')) end"


@query("triage_ranked", store(f"select * from (with {_SCORED}, covered as (select *, {_COVER} as covered_by from scored s) select run_id, id, rule_id, covered_by, cast(row_number() over (partition by run_id order by covered_by is not null, -score, rule_id, id) as integer) as rank from covered)"))
def triage_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's findings, those that a more specific one on the same model covers at the end."""
    rows = _scored(spark, sf_dir)
    fired = rows.groupBy("run_id", "model_name").agg(F.collect_set("rule_id").alias("fired"))  # at most one entry a rule
    covered = F.lit(None).cast("string")
    for rule, by in ops.COVERED_BY.items():
        covered = F.when(F.col("rule_id") == rule, F.array_min(F.array_intersect("fired", F.array(*map(F.lit, by))))).otherwise(covered)
    rows = rows.join(fired, ["run_id", "model_name"]).withColumn("covered_by", covered)
    order = Window.partitionBy("run_id").orderBy(F.col("covered_by").isNotNull(), -F.col("score"), "rule_id", "id")
    return rows.select("run_id", "id", "rule_id", "covered_by", F.row_number().over(order).alias("rank"))


# The mutation corpus as data: outcomes synthesised from parts.
KINDS = ("defect", "latent", "unruled", "benign", "control", "generated")
_OUTCOMES = """outcomes as (select p_partkey as id, list_extract(['defect','latent','unruled','benign','control','generated'], p_partkey % 6 + 1) as kind, p_partkey % 17 <> 0 as applied, p_partkey % 5 <> 0 as oracle_available,
 p_partkey % 3 <> 0 as changed_results, p_partkey % 4 <> 0 as detected, list_extract(['F1','F2','F3'], p_partkey % 3 + 1) as expects_family, list_extract(['F1','F2','F3'], p_size % 3 + 1) as fired_family from part),
classified as (select *, case kind when 'latent' then case when detected then 'latent_caught' else 'latent_missed' end when 'generated' then case when not changed_results then case when detected then 'generated_noise' else 'generated_inert' end when detected then 'generated_caught' else 'generated_MISSED' end
 when 'unruled' then case when detected then 'unruled_caught' else 'unruled_MISSED' end
 else case when case when kind = 'benign' then false when not oracle_available then kind <> 'control' else changed_results end then case when detected then 'true_positive' else 'false_negative' end else case when detected then 'false_positive' else 'true_negative' end end end as cell from outcomes)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), ops.pick(KINDS, k % 6).alias("kind"), (k % 17 != 0).alias("applied"), (k % 5 != 0).alias("oracle_available"), (k % 3 != 0).alias("changed_results"),
        (k % 4 != 0).alias("detected"), ops.pick(("F1", "F2", "F3"), k % 3).alias("expects_family"), ops.pick(("F1", "F2", "F3"), F.col("p_size") % 3).alias("fired_family"),
    )
    kind, found, moved = F.col("kind"), F.col("detected"), F.col("changed_results")
    either = lambda yes, no: F.when(found, yes).otherwise(no)
    defect = F.when(kind == "benign", False).when(~F.col("oracle_available"), kind != "control").otherwise(moved)
    cell = (
        F.when(kind == "latent", either("latent_caught", "latent_missed")).when((kind == "generated") & ~moved, either("generated_noise", "generated_inert"))
        .when(kind == "generated", either("generated_caught", "generated_MISSED")).when(kind == "unruled", either("unruled_caught", "unruled_MISSED"))
        .when(defect, either("true_positive", "false_negative")).otherwise(either("false_positive", "true_negative"))
    )
    return rows.withColumn("cell", cell)


@query("corpus_classify", f"with {_OUTCOMES} select kind, cell, count(*) as n from classified where applied group by kind, cell")
def corpus_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("applied").groupBy("kind", "cell").agg(n())


_CELL = "count_if(cell = '{}')"


@query("corpus_metrics", f"with {_OUTCOMES} select cast(tp as double) / nullif(tp + fn, 0) as recall, cast(tp as double) / nullif(tp + fp, 0) as precision, cast(fp as double) / nullif(fp + tn, 0) as false_positive_rate from (select {_CELL.format('true_positive')} as tp, {_CELL.format('false_negative')} as fn, {_CELL.format('false_positive')} as fp, {_CELL.format('true_negative')} as tn from classified where applied)")
def corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = {"tp": "true_positive", "fn": "false_negative", "fp": "false_positive", "tn": "true_negative"}
    c = _classified(spark, sf_dir).where("applied").agg(*(F.count_if(F.col("cell") == v).alias(k) for k, v in cells.items()))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(a) + F.col(b), F.lit(0)))
    return c.select(share("tp", "fn").alias("recall"), share("tp", "fp").alias("precision"), share("fp", "tn").alias("false_positive_rate"))


_FAILURES = (
    ("not_scored", "kind <> 'generated' and not applied"),
    ("incidental", "applied and kind in ('defect', 'latent') and detected and expects_family <> fired_family"),
    ("missed_defect", "applied and cell = 'false_negative'"),
    ("flagged_control", "applied and kind = 'control' and detected"),
    ("missed_latent", "applied and cell = 'latent_missed'"),
    ("missed_unruled", "applied and cell = 'unruled_MISSED'"),
    ("mislabelled", "applied and kind in ('defect', 'benign', 'control') and oracle_available and (case when kind = 'benign' then changed_results else (kind = 'defect') <> changed_results end)"),
)


@query("corpus_gate", f"with {_OUTCOMES} " + " union all ".join(f"select '{k}' as failure, id from classified where {v}" for k, v in _FAILURES))
def corpus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason why a run of the corpus fails; one scan, a row can fail for several."""
    rows = _classified(spark, sf_dir)
    reasons = F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in _FAILURES))
    return rows.select(F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("failure"), "id")


@query("corpus_mislabelled", f"with {_OUTCOMES} select id, kind, changed_results from classified where {_FAILURES[-1][1]}")
def corpus_mislabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where(_FAILURES[-1][1]).select("id", "kind", "changed_results")


_KNOWN = ("F1001", "F2001", "F3001", "F4002", "F8002", "F9007", "F6001", "F5001", "F7001")


@query("rule_coverage", store(f"select k.rule_id, exists (select 1 from findings f where f.rule_id = k.rule_id and f.severity = 'critical') as fired from (select unnest([{', '.join(repr(k) for k in _KNOWN)}]) as rule_id) k"))
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(k,) for k in _KNOWN], "rule_id string")
    fired = Store(spark, sf_dir).findings.where("severity = 'critical'").select("rule_id").distinct().withColumn("fired", F.lit(True))
    return known.join(fired, "rule_id", "left").select("rule_id", F.coalesce("fired", F.lit(False)).alias("fired"))


# Model search and project profile, over a catalogue of models made from parts.
_CATALOGUE = "catalogue as (select p_partkey as id, lower(replace(p_name, ' ', '_')) as name, list_extract(['view','table','incremental'], p_size % 3 + 1) as materialized, list_extract(['regulatory','finance','Recon','adhoc'], p_partkey % 4 + 1) as tag, list_extract(['staging/','marts/','reporting/'], p_partkey % 3 + 1) as folder, list_extract(['amount_usd','email','period_month','currency_code','qty'], p_partkey % 5 + 1) as column_name from part)"


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), ops.pick(("view", "table", "incremental"), F.col("p_size") % 3).alias("materialized"),
        ops.pick(("regulatory", "finance", "Recon", "adhoc"), k % 4).alias("tag"), ops.pick(("staging/", "marts/", "reporting/"), k % 3).alias("folder"),
        ops.pick(("amount_usd", "email", "period_month", "currency_code", "qty"), k % 5).alias("column_name"),
    )


@query("model_search", f"with {_CATALOGUE} select id, name, materialized, tag from catalogue where lower(tag) = 'recon' and lower(materialized) = 'incremental'")
def model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters without regard to case; given in each other's place they are swapped."""
    tagged, materialized = "INCREMENTAL", "recon"
    known = ("view", "table", "incremental")
    if tagged.lower() in known and materialized.lower() not in known:
        tagged, materialized = materialized, tagged
    rows = _catalogue(spark, sf_dir).where((F.lower("tag") == tagged.lower()) & (F.lower("materialized") == materialized.lower()))
    return rows.select("id", "name", "materialized", "tag")


@query("project_profile", f"with {_CATALOGUE} select count(*) as models, count_if(materialized = 'view') as views, count_if(materialized = 'table') as tables, count_if(materialized = 'incremental') as incrementals, count_if(lower(tag) in ('regulatory', 'recon', 'control')) as governed, count_if(folder in ('marts/', 'reporting/')) as published, count_if(regexp_matches(column_name, 'amount|usd')) as monetary, count_if(regexp_matches(column_name, 'email')) as sensitive, count_if(regexp_matches(column_name, 'currency')) as currency, count_if(regexp_matches(column_name, 'period|month')) as period, quantile_cont(length(name), 0.5) as median_name from catalogue")
def project_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of a project in one pass."""
    column = F.col("column_name")
    return _catalogue(spark, sf_dir).agg(
        n("models"), *(F.count_if(F.col("materialized") == m).alias(f"{m}s") for m in ("view", "table", "incremental")), F.count_if(is_governed(F.array("tag"))).alias("governed"),
        F.count_if(F.col("folder").isin("marts/", "reporting/")).alias("published"), *(F.count_if(marks(column, k)).alias(k) for k in ("monetary", "sensitive", "currency", "period")),
        F.percentile(F.length("name"), 0.5).alias("median_name"),
    )
