"""History and incremental writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history as scd
from ..operators import incremental
from ..plans.ledger import Ledger
from ..sources.tables import table
from . import query
from .ledger_sql import ledger, select

DAYS = ("2024-01-01", "2024-02-01", "2024-03-01")


def accounts(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    """Customers as a source that changes from run to run: segments move, rows come and go, stamps advance."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where((k % 11 != run) & ((k % 13 != 5) | F.lit(run > 0)))
    segment = F.when(k % (7 + run) == 0, F.concat(F.col("c_mktsegment"), F.lit(f"-{run}"))).otherwise(F.col("c_mktsegment"))
    stamp = F.to_date(F.when(k % (5 + run) == 0, F.lit(DAYS[run])).otherwise(F.lit(DAYS[0])))
    return rows.select(k.alias("account_id"), segment.alias("segment"), "c_nationkey", stamp.alias("updated_at"))


def _source_sql(run: int) -> str:
    return f"select c_custkey as account_id, case when c_custkey % {7 + run} = 0 then c_mktsegment || '-{run}' else c_mktsegment end as segment, c_nationkey, case when c_custkey % {5 + run} = 0 then date '{DAYS[run]}' else date '{DAYS[0]}' end as updated_at from customer where c_custkey % 11 <> {run} and (c_custkey % 13 <> 5 or {run} > 0)"


def _run_sql(strategy: str, deletes: str, runs: int = 3) -> str:
    """Common table expressions h0, h1, ... of the history after each run."""
    md5 = lambda p: f"md5(account_id || '|' || {p})"
    out = [f"s{r} as ({_source_sql(r)})" for r in range(runs)]
    first = "updated_at" if strategy == "timestamp" else f"date '{DAYS[0]}'"
    out.append(f"h0 as (select account_id, segment, c_nationkey, updated_at, {first} as valid_from, cast(null as date) as valid_to, {md5(first)} as scd_id, false as is_deleted from s0)")
    for r in range(1, runs):
        at = f"date '{DAYS[r]}'"
        changed = "n.updated_at > c.updated_at" if strategy == "timestamp" else "(n.segment is distinct from c.segment or n.c_nationkey is distinct from c.c_nationkey)"
        stamp = "n.updated_at" if strategy == "timestamp" else at
        moves = f"(n.account_id is not null and c.account_id is not null and {changed})"
        ends = "(n.account_id is null)" if deletes != "ignore" else "false"
        out.append(f"c{r} as (select * from h{r - 1} where valid_to is null and not is_deleted)")
        parts = [
            f"select account_id, segment, c_nationkey, updated_at, valid_from, valid_to, scd_id, is_deleted from h{r - 1} where valid_to is not null or is_deleted",
            f"select c.account_id, c.segment, c.c_nationkey, c.updated_at, c.valid_from, case when {moves} then {stamp} when {ends} then {at} end, c.scd_id, c.is_deleted from c{r} c left join s{r} n on c.account_id = n.account_id",
            f"select n.account_id, n.segment, n.c_nationkey, n.updated_at, {stamp}, null, md5(n.account_id || '|' || {stamp}), false from s{r} n left join c{r} c on c.account_id = n.account_id where c.account_id is null or {moves}",
        ]
        if deletes == "new_record":
            parts.append(f"select c.account_id, c.segment, c.c_nationkey, c.updated_at, {at}, null, md5(c.account_id || '|' || {at}), true from c{r} c left join s{r} n on c.account_id = n.account_id where n.account_id is null")
        out.append(f"h{r} as ({' union all '.join(parts)})")
    return ", ".join(out)


def run(spark: SparkSession, sf_dir: str, strategy: str, deletes: str, runs: int = 3) -> DataFrame:
    config = scd.HistoryConfig(("account_id",), strategy, "updated_at", ("segment", "c_nationkey"), deletes)
    h = scd.first_snapshot(accounts(spark, sf_dir, 0), config, F.lit(DAYS[0]).cast("date"))
    for r in range(1, runs):
        h = scd.snapshot(h, accounts(spark, sf_dir, r), config, F.lit(DAYS[r]).cast("date"))
    return h


COLUMNS = "account_id, segment, c_nationkey, updated_at, valid_from, valid_to, scd_id, is_deleted"


@query("scd2_timestamp", f"with {_run_sql('timestamp', 'invalidate')} select {COLUMNS} from h2")
def scd2_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "timestamp", "invalidate").select(*COLUMNS.split(", "))


@query("scd2_check", f"with {_run_sql('check', 'invalidate')} select {COLUMNS} from h2")
def scd2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "check", "invalidate").select(*COLUMNS.split(", "))


@query(
    "scd2_hard_deletes",
    " union all ".join(f"select '{d}' as deletes, * from (with {_run_sql('check', d)} select count(*) as versions, count_if(valid_to is null and not is_deleted) as current_rows, count_if(is_deleted) as deletions from h2)" for d in ("ignore", "invalidate", "new_record")),
)
def scd2_hard_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for d in ("ignore", "invalidate", "new_record"):
        one = run(spark, sf_dir, "check", d).agg(
            F.count(F.lit(1)).alias("versions"), F.count_if(F.col("valid_to").isNull() & ~F.col("is_deleted")).alias("current_rows"), F.count_if("is_deleted").alias("deletions")
        ).select(F.lit(d).alias("deletes"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("scd2_current", f"with {_run_sql('timestamp', 'invalidate')} select account_id, segment, valid_from from h2 where valid_to is null and not is_deleted")
def scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd.current(run(spark, sf_dir, "timestamp", "invalidate")).select("account_id", "segment", "valid_from")


@query("scd2_current_join", f"with {_run_sql('timestamp', 'invalidate')} select segment, count(*) as n_orders, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as total from orders join (select * from h2 where valid_to is null and not is_deleted) on o_custkey = account_id group by segment")
def scd2_current_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = scd.current(run(spark, sf_dir, "timestamp", "invalidate")).select("account_id", "segment")
    joined = table(spark, sf_dir, "orders").join(now, F.col("o_custkey") == F.col("account_id"))
    return joined.groupBy("segment").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))


_FACTS_SQL = "select event_id, event_id * 7 % (select max(c_custkey) from customer) + 1 as account_id, cast(ts as date) + 30 as on_day from events"


@query("scd2_asof_join", f"with {_run_sql('check', 'invalidate')}, f as ({_FACTS_SQL}) select f.event_id, h.segment, h.valid_from from f join h2 h on f.account_id = h.account_id and h.valid_from <= f.on_day and (h.valid_to is null or f.on_day < h.valid_to)")
def scd2_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("most"))  # one row
    facts = table(spark, sf_dir, "events").crossJoin(F.broadcast(most)).select("event_id", (F.col("event_id") * 7 % F.col("most") + 1).alias("account_id"), F.date_add(F.col("ts").cast("date"), 30).alias("on_day"))
    return scd.as_of(facts, run(spark, sf_dir, "check", "invalidate"), "account_id", "on_day").select("event_id", "segment", "valid_from")


@query("scd2_every_version_fanout", f"with {_run_sql('check', 'invalidate')} select count(*) as joined_rows, count(distinct o_orderkey) as orders_met, cast(count(*) as double) / count(distinct o_orderkey) as rows_per_key from orders join h2 on o_custkey = account_id")
def scd2_every_version_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a join with all versions does to the rows of a fact; versions are counted per key before the join."""
    versions = run(spark, sf_dir, "check", "invalidate").groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "orders").join(versions, F.col("o_custkey") == F.col("account_id"))
    return joined.agg(F.sum("n").alias("joined_rows"), F.count_distinct("o_orderkey").alias("orders_met"), (F.sum("n").cast("double") / F.count_distinct("o_orderkey")).alias("rows_per_key"))


@query("scd2_from_changelog", "select user_id, event_type, event_id, ts as valid_from, lead(ts) over (partition by user_id, event_type order by ts, event_id) as valid_to from events")
def scd2_from_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("ts").alias("valid_from"))
    return rows.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("user_id", "event_type").orderBy("valid_from", "event_id")))


@query("scd2_concat_key", select("select currency_code || '|' || rate_period as rate_key, currency_code, rate_period, rate_pct, rate_period as valid_from, lead(rate_period) over (partition by currency_code order by rate_period) as valid_to from stg_fx_rates"))
def scd2_concat_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = scd.from_changelog(Ledger(spark, sf_dir).stg_fx_rates, ["currency_code"], "rate_period")
    return rates.select(F.concat_ws("|", "currency_code", F.col("rate_period").cast("string")).alias("rate_key"), "currency_code", "rate_period", "rate_pct", "valid_from", "valid_to")


@query("scd2_two_grains", f"with {_run_sql('timestamp', 'invalidate')} select count(*) as row_count, count(distinct account_id) as query_key, count(distinct (account_id, valid_from)) as table_key from h2")
def scd2_two_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of the snapshotted query, and key with valid_from in the table."""
    h = run(spark, sf_dir, "timestamp", "invalidate")
    return h.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("account_id").alias("query_key"), F.count_distinct(F.struct("account_id", "valid_from")).alias("table_key"))


@query("scd2_volatile_growth", " union all ".join(f"select {r + 1} as run, count(*) * {r + 1} as versions, count(*) as current_rows from supplier" for r in range(3)))
def scd2_volatile_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp of the build time makes a new version of every row in every run."""
    config, h, out = scd.HistoryConfig(("s_suppkey",), "timestamp", "stamp"), None, None
    for r in range(3):
        source = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(DAYS[r]).cast("date").alias("stamp"))
        at = F.lit(DAYS[r]).cast("date")
        h = scd.first_snapshot(source, config, at) if h is None else scd.snapshot(h, source, config, at)
        one = h.agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("valid_to").isNull()).alias("current_rows")).select(F.lit(r + 1).alias("run"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# Incremental writes: the target holds revenue up to a period, the batch what a run selects.
CUT, LATE = "2000-06-01", "2000-03-01"
_BASE = "select entry_id, period_month, posting_date, revenue from fr"
_FR = ledger() + ", fr as (select r.entry_id, r.period_month, n.posting_date, r.revenue_usd_e4 as revenue from fct_revenue r join stg_entries n on r.entry_id = n.entry_id)"
_TARGET = f"tgt as ({_BASE} where period_month < date '{CUT}' and hash_part <> 0)".replace("hash_part", "cast(split_part(entry_id, '-', 1) as bigint) % 10")
_BATCH = f"bat as ({_BASE} where period_month >= date '{LATE}' and period_month < date '2001-01-01')"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    led = Ledger(spark, sf_dir)
    rows = led.revenue_recognized.select("entry_id", "period_month", "posting_date", F.col("amount_usd_e4").alias("revenue"))
    part = F.split_part("entry_id", F.lit("-"), F.lit(1)).cast("long") % 10
    target = rows.where((F.col("period_month") < CUT) & (part != 0))
    return rows, target, rows.where((F.col("period_month") >= LATE) & (F.col("period_month") < "2001-01-01"))


_SUMMARY = "select count(*) as row_count, count(distinct entry_id) as key_count, cast(sum(revenue) as bigint) as revenue from"


def _summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("entry_id").alias("key_count"), F.sum("revenue").alias("revenue"))


@query("incr_append_duplicates", f"with {_FR}, {_TARGET}, {_BATCH} {_SUMMARY} (select * from tgt union all select * from bat)")
def incr_append_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, target, batch = _sides(spark, sf_dir)
    return _summary(incremental.append(target, batch))


@query("incr_delete_insert", f"with {_FR}, {_TARGET}, {_BATCH} {_SUMMARY} (select * from tgt where entry_id not in (select entry_id from bat) union all select * from bat)")
def incr_delete_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, target, batch = _sides(spark, sf_dir)
    return _summary(incremental.delete_insert(target, batch, ["entry_id"]))


@query("incr_merge", f"with {_FR}, {_TARGET}, {_BATCH} {_SUMMARY} (select coalesce(b.entry_id, t.entry_id) as entry_id, case when b.entry_id is not null then b.revenue else t.revenue end as revenue from tgt t full outer join bat b on t.entry_id = b.entry_id)")
def incr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, target, batch = _sides(spark, sf_dir)
    return _summary(incremental.merge(target, batch, ["entry_id"]))


_OVERWRITE = "select * from tgt where period_month not in (select distinct period_month from {0}) union all select * from {0}"


@query("incr_partition_overwrite", f"with {_FR}, {_TARGET}, {_BATCH} select period_month, count(*) as n, cast(sum(revenue) as bigint) as revenue from ({_OVERWRITE.format('bat')}) group by period_month")
def incr_partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, target, batch = _sides(spark, sf_dir)
    rows = incremental.overwrite_partitions(target, batch, ["period_month"])
    return rows.groupBy("period_month").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue"))


@query("incr_second_pass", f"with {_FR}, {_TARGET}, {_BATCH}, once as ({_OVERWRITE.format('bat')}), twice as (select * from once where period_month not in (select distinct period_month from bat) union all select * from bat) select (select count(*) from once) as first_pass, (select count(*) from twice) as second_pass")
def incr_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same builder run twice: an overwrite settles, it does not grow."""
    _, target, batch = _sides(spark, sf_dir)
    once = incremental.overwrite_partitions(target, batch, ["period_month"])
    twice = incremental.overwrite_partitions(once, batch, ["period_month"])
    return once.agg(F.count(F.lit(1)).alias("first_pass")).crossJoin(twice.agg(F.count(F.lit(1)).alias("second_pass")))


_NARROW = "nar as (select * from bat where posting_date >= period_month)"


@query("incr_partial_partition_loss", f"with {_FR}, {_TARGET}, {_BATCH}, {_NARROW} select (select count(*) from ({_OVERWRITE.format('bat')})) as whole_partitions, (select count(*) from ({_OVERWRITE.format('nar')})) as narrow_filter, (select count(*) from ({_OVERWRITE.format('bat')})) - (select count(*) from ({_OVERWRITE.format('nar')})) as lost_rows")
def incr_partial_partition_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter narrower than the partition replaces the partition by a part of itself."""
    _, target, batch = _sides(spark, sf_dir)
    n = lambda b, name: incremental.overwrite_partitions(target, b, ["period_month"]).agg(F.count(F.lit(1)).alias(name))
    rows = n(batch, "whole_partitions").crossJoin(n(batch.where("posting_date >= period_month"), "narrow_filter"))
    return rows.withColumn("lost_rows", F.col("whole_partitions") - F.col("narrow_filter"))


@query("incr_lookback_filter", f"with {_FR}, {_TARGET} select period_month, count(*) as n from fr where period_month >= (select coalesce(max(period_month), date '0001-01-01') - interval 2 month from tgt) group by period_month")
def incr_lookback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, target, _ = _sides(spark, sf_dir)
    return incremental.lookback(rows, target, "period_month", 2).groupBy("period_month").agg(F.count(F.lit(1)).alias("n"))


@query("incr_late_rows", f"with {_FR}, {_TARGET}, lo as (select (select max(period_month) from tgt) as latest) select count_if(period_month >= latest - interval 3 month) as wide, count_if(period_month >= latest - interval 1 month) as narrow, count_if(period_month >= latest - interval 3 month) - count_if(period_month >= latest - interval 1 month) as lost_late_rows from fr, lo")
def incr_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows that a narrower lookback no longer sees."""
    rows, target, _ = _sides(spark, sf_dir)
    n = lambda months, name: incremental.lookback(rows, target, "period_month", months).agg(F.count(F.lit(1)).alias(name))
    return n(3, "wide").crossJoin(n(1, "narrow")).withColumn("lost_late_rows", F.col("wide") - F.col("narrow"))
