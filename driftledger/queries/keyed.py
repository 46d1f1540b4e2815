"""Keyed differences between two builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import measure
from ..operators.keyed import KeyedDiff, refusal
from ..plans.ledger import EDGES, Ledger
from ..sources.tables import table
from . import query
from .ledger_sql import both

BASE = "select o_orderkey, cast(o_orderdate as date) as order_date, cast(date_trunc('month', o_orderdate) as date) as period, o_orderstatus, o_totalprice, case when o_orderkey % 41 <> 0 then o_custkey end as o_custkey from orders where o_orderkey % 97 <> 3"
HEAD = "select o_orderkey, cast(o_orderdate as date) as order_date, cast(date_trunc('month', o_orderdate) as date) as period, case when o_orderkey % 53 = 1 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 67 = 2 then o_totalprice + 1 when o_orderkey % 67 = 5 then null when o_orderkey % 67 = 7 then o_totalprice * (1 + 1e-12) else o_totalprice end as o_totalprice, case when o_orderkey % 43 <> 0 then o_custkey end as o_custkey from orders where o_orderkey % 89 <> 4"
COLUMNS = ("order_date", "o_orderstatus", "o_totalprice", "o_custkey")


def builds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders in two builds: rows dropped on either side, values edited, nulls, and noise within the tolerance."""
    k = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"), F.trunc("o_orderdate", "month").alias("period"), "o_orderstatus", "o_totalprice", "o_custkey")
    base = raw.where(k % 97 != 3).withColumn("o_custkey", F.when(k % 41 != 0, F.col("o_custkey")))
    price = F.col("o_totalprice")
    edited = F.when(k % 67 == 2, price + 1).when(k % 67 == 5, None).when(k % 67 == 7, price * (1 + 1e-12)).otherwise(price)
    head = raw.where(k % 89 != 4).withColumns({"o_orderstatus": F.when(k % 53 == 1, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": edited, "o_custkey": F.when(k % 43 != 0, F.col("o_custkey"))})
    return base, head


def diff(spark: SparkSession, sf_dir: str) -> KeyedDiff:
    return KeyedDiff(*builds(spark, sf_dir), ["o_orderkey", "period"])


def _number(c: str) -> str:
    return f"case when b.{c} is null or h.{c} is null then (b.{c} is null) <> (h.{c} is null) else abs(cast(b.{c} as double) - cast(h.{c} as double)) > 1e-9 * greatest(abs(cast(b.{c} as double)), abs(cast(h.{c} as double))) end"


PAIRED = f"""with b as ({BASE}), h as ({HEAD}),
paired as (select coalesce(b.o_orderkey, h.o_orderkey) as o_orderkey, coalesce(b.period, h.period) as period,
 case when b.o_orderkey is null then 'added' when h.o_orderkey is null then 'removed' else 'paired' end as side,
 b.o_orderkey is not null and h.o_orderkey is not null and b.order_date is distinct from h.order_date as c_order_date,
 b.o_orderkey is not null and h.o_orderkey is not null and b.o_orderstatus is distinct from h.o_orderstatus as c_o_orderstatus,
 b.o_orderkey is not null and h.o_orderkey is not null and {_number("o_totalprice")} as c_o_totalprice,
 b.o_orderkey is not null and h.o_orderkey is not null and {_number("o_custkey")} as c_o_custkey
 from b full outer join h on b.o_orderkey = h.o_orderkey and b.period = h.period)"""
ANY = "(" + " or ".join(f"c_{c}" for c in COLUMNS) + ")"
BY_COLUMN = " union all ".join(f"select '{c}' as column_name, count_if(c_{c}) as changed from paired" for c in COLUMNS)


@query("keyed_diff_counts", f"{PAIRED} select count_if(side = 'added') as added, count_if(side = 'removed') as removed, count_if({ANY}) as changed, count_if(side = 'paired') as paired from paired")
def keyed_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(spark, sf_dir).counts()


@query("keyed_diff_by_column", f"{PAIRED} select * from ({BY_COLUMN})")
def keyed_diff_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(spark, sf_dir).by_column()


@query("keyed_diff_sample_keys", f"{PAIRED} select o_orderkey || ' | ' || period as key_text, side from paired where side <> 'paired' or {ANY} order by key_text, side limit 5")
def keyed_diff_sample_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(spark, sf_dir).sample()


@query("keyed_diff_top_columns", f"{PAIRED} select column_name, changed, rank from (select *, cast(row_number() over (order by changed desc, column_name) as integer) as rank from ({BY_COLUMN}) where changed > 0) where rank <= 4")
def keyed_diff_top_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four columns that changed most; one row a column, so that a single window holds them."""
    rows = diff(spark, sf_dir).by_column().where("changed > 0")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("changed").desc(), "column_name"))).where("rank <= 4")


@query("keys_added_removed", f"{PAIRED} select o_orderkey, period, side from paired where side <> 'paired'")
def keys_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti joins both ways."""
    base, head = (df.select("o_orderkey", "period") for df in builds(spark, sf_dir))
    added = head.join(base, ["o_orderkey", "period"], "left_anti").withColumn("side", F.lit("added"))
    return added.unionByName(base.join(head, ["o_orderkey", "period"], "left_anti").withColumn("side", F.lit("removed")))


def _refused(name: str, key: str, most: int | None = None) -> str:
    counts = lambda t, k: f"(select count(*) as n, count(distinct {k}) + case when count(*) > count({k}) then 1 else 0 end as keys, count(*) - count({k}) as nulls from {t})"
    over = f"when greatest(b.n, h.n) > {most} then 'over the row budget' " if most else ""
    return f"select '{name}' as name, case when h.n <> h.keys then 'key repeats in head' when b.n <> b.keys then 'key repeats in base' {over}when b.nulls + h.nulls > 0 then 'nulls in the key' end as reason from {counts('b', key if name != 'null_key' else 'o_orderkey')} b, {counts('h', key)} h"


@query("null_key_refusal", f"with b as ({BASE}), h as ({HEAD}) " + " union all ".join((_refused("clean", "o_orderkey"), _refused("null_key", "nullif(o_orderkey, 7)"), _refused("repeated", "period"), _refused("large", "o_orderkey", 100))))
def null_key_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairing is refused with a reason, and a refusal is no finding of no change."""
    base, head = builds(spark, sf_dir)
    holes = head.withColumn("o_orderkey", F.when(F.col("o_orderkey") != 7, F.col("o_orderkey")))
    cases = {
        "clean": refusal(base, head, ["o_orderkey"]),
        "null_key": refusal(base, holes, ["o_orderkey"]),
        "repeated": refusal(base, head, ["period"]),
        "large": refusal(base, head, ["o_orderkey"], most_rows=100),
    }
    out = None
    for name, df in cases.items():
        one = df.select(F.lit(name).alias("name"), "reason")
        out = one if out is None else out.unionByName(one)
    return out


@query("period_restatement", f"{PAIRED} select cast((select max(period) from paired) as varchar) as latest_period, cast(coalesce(sum(case when period < (select max(period) from paired) and (side <> 'paired' or {ANY}) then 1 else 0 end), 0) as bigint) as prior_rows, cast(min(case when side <> 'paired' or {ANY} then period end) as varchar) as earliest_changed from paired")
def period_restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(spark, sf_dir).periods("period")


MODELS = {
    "fct_regulatory_summary": (("period_month", "entity_code", "currency_code"), ("amount_minor", "revenue_usd_e4")),
    "fct_account_period_summary": (("account_id", "period_month"), ("entry_count", "net_usd_e4")),
    "revenue_recognized": (("entry_id",), ("amount_minor", "amount_usd_e4")),
    "stg_contracts": (("contract_id",), ("term_months",)),
}
EDIT = "contract_inner"


def _long_sql(model: str) -> str:
    keys, amounts = MODELS[model]
    value = lambda s: [f"('rows', '*', (select cast(count(*) as decimal(38,4)) from {model}{s}))"] + [f"('sum', '{c}', (select cast(sum(cast({c} as decimal(28,4))) as decimal(38,4)) from {model}{s}))" for c in amounts] + [f"('nulls', '{c}', (select cast(count(*) - count({c}) as decimal(38,4)) from {model}{s}))" for c in (*keys, *amounts)]
    return f"select '{model}' as model, b.metric, b.column_name, b.before, h.after from (values {', '.join(value('_b'))}) b(metric, column_name, before) join (values {', '.join(value('_h'))}) h(metric, column_name, after) on b.metric = h.metric and b.column_name = h.column_name"


LONG_SQL = " union all ".join(map(_long_sql, MODELS))


def long_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head, out = Ledger(spark, sf_dir), Ledger(spark, sf_dir, EDIT), None
    for model, (keys, amounts) in MODELS.items():
        one = measure.long_delta(getattr(base, model), getattr(head, model), measure.Delta(model, keys, amounts))
        out = one if out is None else out.unionByName(one)
    return out


@query("diff_tables_long", both(f"select * from ({LONG_SQL})", EDIT))
def diff_tables_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_deltas(spark, sf_dir)


_MOVED = "case when metric = 'sum' then case when before is null or after is null then (before is null) <> (after is null) else abs(cast(before as double) - cast(after as double)) > greatest(1e-9, 1e-12 * greatest(abs(cast(before as double)), abs(cast(after as double)))) end else before is distinct from after end"
MATERIAL_SQL = f"select model, bool_or({_MOVED}) as is_material, count_if({_MOVED}) as moved from ({LONG_SQL}) group by model"


@query("is_material", both(MATERIAL_SQL, EDIT))
def is_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.material(long_deltas(spark, sf_dir))


@query("max_abs_row_delta", both(f"select model, cast(abs(after - before) as bigint) as row_delta from ({LONG_SQL}) where metric = 'rows' order by row_delta desc, model limit 1", EDIT))
def max_abs_row_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_deltas(spark, sf_dir).where("metric = 'rows'").select("model", F.abs(F.col("after") - F.col("before")).cast("long").alias("row_delta"))
    return rows.orderBy(F.col("row_delta").desc(), "model").limit(1)


FINDINGS = (("F1002", "revenue_recognized", "likely"), ("F2001", "fct_regulatory_summary", "possible"), ("F3001", "stg_contracts", "proven"))
_VALUES = ", ".join(str(f) for f in FINDINGS)


@query("attach_execution", both(f"select rule_id, f.model, case when is_material then 'measured' else confidence end as confidence, coalesce(moved, 0) as moved from (values {_VALUES}) f(rule_id, model, confidence) left join ({MATERIAL_SQL}) m on f.model = m.model", EDIT))
def attach_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding on a model whose numbers moved counts as measured."""
    found = spark.createDataFrame(FINDINGS, "rule_id string, model string, confidence string")
    rows = found.join(measure.material(long_deltas(spark, sf_dir)), "model", "left")
    return rows.select("rule_id", "model", F.when(F.col("is_material"), "measured").otherwise(F.col("confidence")).alias("confidence"), F.coalesce("moved", F.lit(0)).alias("moved"))


_STATUS = "(select 'm' || p_partkey as name, case when p_size % 9 = 0 then 'error' when p_size % 9 < 8 then 'success' end as base_status, case when p_size % 4 = 0 then 'error' else 'success' end as head_status from part)"


@query("build_failures", f"select name from {_STATUS} where head_status = 'error' and base_status is distinct from 'error'")
def build_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that fail in head and did not in base, where they may be new."""
    size = F.col("p_size")
    base = F.when(size % 9 == 0, "error").when(size % 9 < 8, "success")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("name"), base.alias("base_status"), F.when(size % 4 == 0, "error").otherwise("success").alias("head_status"))
    return rows.where((F.col("head_status") == "error") & ~F.col("base_status").eqNullSafe("error")).select("name")


GRAINS = {"entries_converted": ("entry_id",), "fct_regulatory_summary": ("period_month", "entity_code", "currency_code"), "stg_contracts": ("contract_id",)}


@query("grain_regressions", both("select * from (" + " union all ".join(f"select '{m}' as model, (select cast(count(*) as double) / count(distinct ({', '.join(k)})) from {m}_b) as before, (select cast(count(*) as double) / count(distinct ({', '.join(k)})) from {m}_h) as after" for m, k in GRAINS.items()) + ") where after > 1 and after > before", "fx_any_period"))
def grain_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models whose key repeats in head and did so less in base."""
    base, head, out = Ledger(spark, sf_dir), Ledger(spark, sf_dir, "fx_any_period"), None
    for model, keys in GRAINS.items():
        b, h = (measure.grain(getattr(x, model), list(keys)).select(F.col("rows_per_key").alias(n)) for x, n in ((base, "before"), (head, "after")))
        one = b.crossJoin(h).select(F.lit(model).alias("model"), "before", "after")
        out = one if out is None else out.unionByName(one)
    return out.where("after > 1 and after > before")


_RESTATED = """select 'fct_regulatory_summary' as model, period_month, count(*) as moved_rows from (select coalesce(b.period_month, h.period_month) as period_month, b.revenue_usd_e4 as x, h.revenue_usd_e4 as y from fct_regulatory_summary_b b
 full outer join fct_regulatory_summary_h h on b.period_month = h.period_month and b.entity_code = h.entity_code and b.currency_code = h.currency_code) where x is distinct from y and period_month < (select max(period_month) from fct_regulatory_summary_b) group by period_month"""


@query("restated_periods", both(_RESTATED, "with_reversals"))
def restated_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed periods of a leaf model in which a figure moved."""
    model, keys = "fct_regulatory_summary", ["period_month", "entity_code", "currency_code"]
    assert model not in {parent for parent, _ in EDGES}
    base, head = Ledger(spark, sf_dir).fct_regulatory_summary, Ledger(spark, sf_dir, "with_reversals").fct_regulatory_summary
    d = KeyedDiff(base.select(*keys, "revenue_usd_e4"), head.select(*keys, "revenue_usd_e4"), keys)
    latest = base.agg(F.max("period_month").alias("latest"))
    moved = d.rows.where((F.col("side") != "paired") | d.any_changed).crossJoin(F.broadcast(latest)).where("period_month < latest")
    return moved.groupBy("period_month").agg(F.count(F.lit(1)).alias("moved_rows")).select(F.lit(model).alias("model"), "period_month", "moved_rows")


_SUGGEST = {"stg_accounts": ("account_id",), "stg_contracts": ("contract_id",), "stg_fx_rates": ("currency_code", "rate_period"), "stg_entries": ("account_id",), "fct_account_period_summary": ("account_id", "period_month")}
ASSERTED = ("stg_contracts",)


@query("suggest_tests", both("select model, key from (" + " union all ".join(f"select '{m}' as model, '{'+'.join(k)}' as key, (select count(*) = count(distinct ({', '.join(k)})) from {m}_b) as ok" for m, k in _SUGGEST.items()) + f") where ok and model not in {str(ASSERTED).replace(',)', ')')}"))
def suggest_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold in the data and that no declared test asserts yet."""
    ledger_, out = Ledger(spark, sf_dir), None
    for model, keys in _SUGGEST.items():
        one = measure.grain(getattr(ledger_, model), list(keys)).where("is_unique").select(F.lit(model).alias("model"), F.lit("+".join(keys)).alias("key"))
        out = one if out is None else out.unionByName(one)
    asserted = spark.createDataFrame([(m,) for m in ASSERTED], "model string")
    return out.join(F.broadcast(asserted), "model", "left_anti")


_FLAG = """select column_name, rows_before, rows_after, changed, restated_closed from (select count(b.period_month) as rows_before, count(h.period_month) as rows_after, %s, count_if(b.revenue_usd_e4 is distinct from h.revenue_usd_e4 and coalesce(b.period_month, h.period_month) < (select max(period_month) from fct_regulatory_summary_b)) as restated_closed
 from fct_regulatory_summary_b b full outer join fct_regulatory_summary_h h on b.period_month = h.period_month and b.entity_code = h.entity_code and b.currency_code = h.currency_code), lateral (values %s) t(column_name, changed)"""
_MART = ("entry_count", "account_count", "amount_minor", "revenue_usd_e4")


@query("flagship_restatement", both(_FLAG % (", ".join(f"count_if(b.{c} is distinct from h.{c} and b.period_month is not null and h.period_month is not null) as c_{c}" for c in _MART), ", ".join(f"('{c}', c_{c})" for c in _MART)), "fx_any_period"))
def flagship_restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart built twice, head with a rate join that forgets the period: rows hold, figures move."""
    keys = ["period_month", "entity_code", "currency_code"]
    base, head = Ledger(spark, sf_dir).fct_regulatory_summary, Ledger(spark, sf_dir, "fx_any_period").fct_regulatory_summary
    d = KeyedDiff(base, head, keys)
    # One row a period, so that the latest is known without a second build of either mart.
    per = d.rows.groupBy("period_month").agg(
        F.count_if(F.col("in_base")).alias("b"), F.count_if(F.col("in_head")).alias("h"), F.count_if((F.col("side") != "paired") | F.col("changed_revenue_usd_e4")).alias("moved"),
        *(F.count_if(F.col(f"changed_{c}")).alias(c) for c in d.columns),
    )
    latest = F.max(F.when(F.col("b") > 0, F.struct("period_month", "moved")))
    row = per.agg(F.sum("b").alias("rows_before"), F.sum("h").alias("rows_after"), (F.sum("moved") - latest["moved"]).alias("restated_closed"), *(F.sum(c).alias(c) for c in d.columns))
    return row.unpivot(["rows_before", "rows_after", "restated_closed"], d.columns, "column_name", "changed").select("column_name", "rows_before", "rows_after", "changed", "restated_closed")
