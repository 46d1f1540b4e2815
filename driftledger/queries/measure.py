"""Measurement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import measure
from ..plans.catalyst import structural_keys
from ..plans.ledger import Ledger
from ..sources.tables import table
from . import query
from .ledger_sql import ledger, select

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("scan_filter_project", "select l_orderkey, l_linenumber, cast(l_shipdate as date) as ship_date, cast(round(l_extendedprice * 100) as bigint) as price_minor from lineitem where l_returnflag = 'R' and l_quantity >= 30")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 30))
    return rows.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ship_date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price_minor"))


@query(
    "table_shape",
    " union all ".join(
        f"select '{t}' as table_name, (select count(*) from {t}) as row_count, cast(count(*) as integer) as column_count, cast(count_if(data_type in ('INTEGER','BIGINT','DOUBLE')) as integer) as numeric_columns from information_schema.columns where table_name = '{t}'"
        for t in TABLES
    ),
)
def table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in TABLES:
        one = measure.shape(table(spark, sf_dir, t), t)
        out = one if out is None else out.unionByName(one)
    return out


@query("money_sums", "select " + ", ".join(f"cast(sum(cast({c} as decimal(18,4))) as decimal(38,4)) as {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " from lineitem")
def money_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.sums(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


_CONTRACT = "select entry_id, contract_id, case when amount_minor % 10 <> 0 then amount_minor end as amount from stg_entries"


@query("null_rates", select("select cast(count(*) - count(entry_id) as double) / nullif(count(*), 0) as entry_id, cast(count(*) - count(contract_id) as double) / nullif(count(*), 0) as contract_id, cast(count(*) - count(amount) as double) / nullif(count(*), 0) as amount from (" + _CONTRACT + ")"))
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Ledger(spark, sf_dir).stg_entries.select("entry_id", "contract_id", F.when(F.col("amount_minor") % 10 != 0, F.col("amount_minor")).alias("amount"))
    return measure.null_rates(rows, ["entry_id", "contract_id", "amount"])


@query("distinct_key_count", select("select count(distinct (account_id, contract_id)) as key_count, count(*) as row_count from stg_entries"))
def distinct_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).stg_entries.agg(measure.distinct_keys(["account_id", "contract_id"]).alias("key_count"), F.count(F.lit(1)).alias("row_count"))


_KEYS = {"lineitem": (("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey", "l_suppkey")), "orders": (("o_orderkey",), ("o_custkey",)), "events": (("event_id",),)}


def _grain_sql(t: str, keys: tuple[str, ...]) -> str:
    null = " or ".join(f"{k} is null" for k in keys)
    return f"select '{t}' as table_name, '{'+'.join(keys)}' as key, row_count, key_count, null_key_rows, cast(row_count as double) / nullif(key_count, 0) as rows_per_key, row_count = key_count and null_key_rows = 0 as is_unique from (select count(*) as row_count, count(distinct ({', '.join(keys)},)) as key_count, cast(coalesce(sum(case when {null} then 1 else 0 end), 0) as bigint) as null_key_rows from {t})"


@query("grain_measure", " union all ".join(_grain_sql(t, k) for t, keys in _KEYS.items() for k in keys).replace(",))", "))"))
def grain_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, keys in _KEYS.items():
        for k in keys:
            one = measure.grain(table(spark, sf_dir, t), list(k)).select(F.lit(t).alias("table_name"), F.lit("+".join(k)).alias("key"), "*")
            out = one if out is None else out.unionByName(one)
    return out


_TYPES = "case column_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'INTEGER' then 'int' else lower(column_type) end"


def _schema(body: str) -> str:
    return f"(select column_name as c, {_TYPES} as t from (describe {select(body)}))"


@query("schema_diff", f"""with b as {_schema("select entry_id, amount_minor, account_type from stg_entries join stg_accounts using (account_id)")}, a as {_schema("select entry_id, cast(amount_minor as decimal(38,6)) as amount_minor, account_type as segment from stg_entries join stg_accounts using (account_id)")}
select coalesce(b.c, a.c) as "column", case when b.c is null then 'added' when a.c is null then 'removed' else 'retyped' end as change, b.t as type_before, a.t as type_after from b full join a on b.c = a.c where b.t is distinct from a.t""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schemas of two revisions of a model; no row is read."""
    ledger_ = Ledger(spark, sf_dir)
    base = ledger_.stg_entries.join(ledger_.stg_accounts, "account_id").select("entry_id", "amount_minor", "account_type")
    head = base.select("entry_id", F.col("amount_minor").cast("decimal(38,6)").alias("amount_minor"), F.col("account_type").alias("segment"))
    return measure.schema_diff(spark, base.schema, head.schema)


_DECLARED = (("entity_code", "string"), ("entity_ref", "int"), ("n_accounts", "bigint"), ("entity_label", "string"))


@query("contract_check", f"""with d as (select * from (values {", ".join(map(str, _DECLARED))}) t(c, t)), p as {_schema("select entity_code, entity_ref, n_accounts from entity_reference")}
select d.c as "column", case when p.c is null then 'missing' else 'declared ' || d.t || ', produced ' || p.t end as problem from d left join p on d.c = p.c where d.t is distinct from p.t""")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.contract_violations(spark, dict(_DECLARED), Ledger(spark, sf_dir).entity_reference.schema)


@query("approx_vs_exact", "select count(distinct l_partkey) as exact_parts, true as within_five_percent from lineitem")
def approx_vs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An approximate count is close and still not the figure to report."""
    exact, near = F.count_distinct("l_partkey"), F.approx_count_distinct("l_partkey", 0.01)
    return table(spark, sf_dir, "lineitem").agg(exact.alias("exact_parts"), (F.abs(near - exact) <= 0.05 * exact).alias("within_five_percent"))


@query("fanout_multiplier", f"with {ledger()}, {ledger('fx_any_period', suffix='_h')} select 'entries_converted' as model, (select count(*) from entries_converted) as rows_before, (select count(*) from entries_converted_h) as rows_after, (select cast(count(*) as double) / count(distinct entry_id) from entries_converted_h) as rows_per_key")
def fanout_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per key once a join forgets one of its two keys."""
    before = Ledger(spark, sf_dir).entries_converted.agg(F.count(F.lit(1)).alias("rows_before"))
    after = Ledger(spark, sf_dir, "fx_any_period").entries_converted
    # Every entry meets each of its currency's rates, so the rows after are counted before the join makes them.
    counted = after.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows_after"), (F.sum("n").cast("double") / F.count(F.lit(1))).alias("rows_per_key"))
    return before.crossJoin(counted).select(F.lit("entries_converted").alias("model"), "rows_before", "rows_after", "rows_per_key")


@query("cartesian_multiplier", "select (select count(*) from nation) as left_rows, (select count(*) from region) as right_rows, count(*) as joined_rows from nation, region")
def cartesian_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defect itself: a join without a condition, on the two smallest tables (25 and 5 rows by definition)."""
    left, right = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(left, "left_rows").crossJoin(n(right, "right_rows")).crossJoin(n(left.crossJoin(F.broadcast(right)), "joined_rows"))


@query("dedup_row_number", select("select l_orderkey, l_linenumber, l_partkey, l_suppkey from lines"))
def dedup_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("grouping_sets_no_key", "select n_regionkey, n_name, count(*) as n, grouping_id(n_regionkey, n_name) as level, false as has_key from customer join nation on c_nationkey = n_nationkey group by cube (n_regionkey, n_name)")
def grouping_sets_no_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets: their columns are no key, and the plan's analysis says so."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cubed = joined.cube("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return cubed.withColumn("has_key", F.lit(bool(structural_keys(cubed))))


@query("not_in_null_trap", "select (select count(*) from part where p_partkey not in (select case when l_partkey % 12 <> 0 then l_partkey end from lineitem)) as kept_by_not_in, (select count(*) from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_partkey % 12 <> 0)) as kept_by_not_exists")
def not_in_null_trap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN over a list with a null keeps nothing; an anti join keeps what is meant."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    listed = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 12 != 0, F.col("l_partkey")).alias("k"))
    # The null-aware answer by counts: one null in the list empties the result, so that the pairwise join is not needed.
    nulls = listed.agg(F.count_if(F.col("k").isNull()).alias("nulls"))
    kept = part.join(listed, F.col("p_partkey") == F.col("k"), "left_anti").agg(F.count(F.lit(1)).alias("kept_by_not_exists"))
    return kept.crossJoin(nulls).select(F.when(F.col("nulls") > 0, 0).otherwise(F.col("kept_by_not_exists")).cast("long").alias("kept_by_not_in"), "kept_by_not_exists")


@query("union_breaks_key", select("select count(*) as row_count, count(distinct (account_id, period_month)) as claimed_key, count(distinct (account_id, period_month, activity_type)) as true_key, false as proven from account_activity"))
def union_breaks_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each branch of the union has its key; the union has not."""
    activity = Ledger(spark, sf_dir).account_activity
    return activity.agg(F.count(F.lit(1)).alias("row_count"), measure.distinct_keys(["account_id", "period_month"]).alias("claimed_key"), measure.distinct_keys(["account_id", "period_month", "activity_type"]).alias("true_key")).withColumn(
        "proven", F.lit(bool(structural_keys(activity)))
    )


@query("window_rank_pin", "select c_mktsegment, c_custkey from (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rn from customer) where rn = 1")
def window_rank_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pinned rank proves its partition columns to be a key."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("c_mktsegment", "c_custkey")
