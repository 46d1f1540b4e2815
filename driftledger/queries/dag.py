"""The ledger's models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ledger import Ledger
from ..sources.tables import table
from . import query
from .ledger_sql import select


def _model(key: str, model: str, columns: str) -> None:
    @query(key, select(f"select {columns} from {model}"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(Ledger(spark, sf_dir), model).select(*columns.split(", "))


for _key, _name, _columns in (
    ("dag_stg_accounts", "stg_accounts", "account_id, account_name, account_type, entity_code, currency_code, is_intercompany"),
    ("dag_stg_contracts", "stg_contracts", "contract_id, recognition_method, term_months"),
    ("dag_stg_fx_rates", "stg_fx_rates", "currency_code, rate_period, rate_pct"),
    ("dag_stg_entries", "stg_entries", "entry_id, account_id, posting_date, period_month, entry_type, amount_minor, contract_id, is_reversal"),
    ("dag_entity_reference", "entity_reference", "entity_code, entity_ref, n_accounts"),
    ("dag_entries_converted", "entries_converted", "entry_id, currency_code, period_month, entity_code, rate_pct, amount_minor, amount_usd_e4"),
    ("dag_revenue_recognized", "revenue_recognized", "entry_id, entity_code, currency_code, period_month, contract_id, recognition, term_months, amount_usd_e4"),
    ("dag_account_activity_union", "account_activity", "account_id, period_month, activity_type, entry_count, amount_usd_e4"),
    ("dag_dim_entities", "dim_entities", "entity_code, entity_label"),
    ("dag_fct_revenue", "fct_revenue", "entry_id, account_id, entity_code, currency_code, period_month, recognition, revenue_usd_e4"),
    ("dag_account_period_summary", "fct_account_period_summary", "account_id, period_month, entry_count, net_usd_e4"),
    ("dag_regulatory_summary", "fct_regulatory_summary", "period_month, entity_code, currency_code, entry_count, account_count, amount_minor, revenue_usd_e4"),
    ("dag_revenue_reported", "fct_revenue_reported", "period_month, entity_code, revenue_cents"),
):
    _model(_key, _name, _columns)


@query("deferred_read", select("select r.entity_code, count(*) as n_entries, cast(sum(r.revenue_usd_e4) as bigint) as revenue_usd_e4 from fct_revenue r group by r.entity_code"))
def deferred_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that is not built in this run is read from the state of an earlier one."""
    state = {"fct_revenue": Ledger(spark, sf_dir).fct_revenue}
    built: dict[str, DataFrame] = {}
    revenue = built.get("fct_revenue", state["fct_revenue"])
    return revenue.groupBy("entity_code").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("revenue_usd_e4").alias("revenue_usd_e4"))


_INTERMEDIATE = """select o_orderkey, o_custkey, upper(o_orderpriority) as priority, c_mktsegment, n_name, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as integer) as seq
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey"""


def _intermediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return joined.select("o_orderkey", "o_custkey", F.upper("o_orderpriority").alias("priority"), "c_mktsegment", "n_name", seq.alias("seq"))


@query("synthetic_intermediate", _INTERMEDIATE)
def synthetic_intermediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained left joins and a sequence column."""
    return _intermediate(spark, sf_dir)


@query("synthetic_mart_union", f"with i as ({_INTERMEDIATE}) select n_name, count(*) as n, cast(max(seq) as bigint) as longest from (select n_name, seq from i where priority = '1-URGENT' union all select n_name, seq from i where seq = 1) group by n_name")
def synthetic_mart_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate over a union in its source."""
    rows = _intermediate(spark, sf_dir)
    urgent, first = rows.where("priority = '1-URGENT'"), rows.where("seq = 1")
    both = urgent.select("n_name", "seq").unionByName(first.select("n_name", "seq"))
    return both.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.max("seq").cast("long").alias("longest"))
