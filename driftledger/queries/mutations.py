"""Metamorphic pairs: a query and the same query with one edit, and how far its figures move."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ledger import Ledger
from ..sources.tables import table
from . import query
from .ledger_sql import ledger

_FIGURES = "count(*) as n, coalesce(cast(sum(amount_usd_e4) as bigint), 0) as total"


def _delta(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
    rows = before.crossJoin(after)  # one row a side
    return rows.select(F.lit(name).alias("mutation"), "rows_before", "rows_after", "total_before", "total_after", ((F.col("rows_before") != F.col("rows_after")) | (F.col("total_before") != F.col("total_after"))).alias("moved"))


def _sql(name: str, before: str, after: str, ctes: str = "") -> str:
    head = f"with {ctes} " if ctes else ""
    return f"{head}select '{name}' as mutation, b.n as rows_before, h.n as rows_after, b.total as total_before, h.total as total_after, b.n <> h.n or b.total <> h.total as moved from ({before}) b, ({after}) h"


def _figures(df: DataFrame, amount: str | Column, side: str) -> DataFrame:
    c = F.col(amount) if isinstance(amount, str) else amount
    return df.agg(F.count(F.lit(1)).alias(f"rows_{side}"), F.coalesce(F.sum(c).cast("long"), F.lit(0)).alias(f"total_{side}"))


def _revision(name: str, base: tuple[str, ...], head: tuple[str, ...]) -> None:
    @query(name, _sql(name, f"select {_FIGURES} from revenue_recognized_b", f"select {_FIGURES} from revenue_recognized_h", f"{ledger(*base, suffix='_b')}, {ledger(*head, suffix='_h')}"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, h = (Ledger(spark, sf_dir, *x).revenue_recognized for x in (base, head))
        return _delta(name, _figures(b, "amount_usd_e4", "before"), _figures(h, "amount_usd_e4", "after"))


_revision("mutation_join_to_inner", (), ("contract_inner",))
_revision("mutation_join_to_left", ("contract_inner",), ())
_revision("mutation_and_to_or", (), ("either_filter",))
_revision("mutation_not_removed", (), ("with_reversals",))


def _pair(name: str, source: str, before: tuple[str, str, Callable[[DataFrame], DataFrame]], after: tuple[str, str, Callable[[DataFrame], DataFrame]]) -> None:
    """(SQL of the rows with an amount, amount, frame) of both sides."""
    sql = [f"select count(*) as n, coalesce(cast(sum({amount}) as bigint), 0) as total from ({rows})" for rows, amount, _ in (before, after)]

    @query(name, _sql(name, *sql))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        (_, x, f), (_, y, g) = before, after
        return _delta(name, _figures(f(df), F.expr(x), "before"), _figures(g(df), F.expr(y), "after"))


_LIMIT = "(select max(l_quantity) from lineitem)"
_pair("mutation_gte_to_gt", "lineitem", ("select * from lineitem where l_quantity >= 25", "l_linenumber", lambda d: d.where("l_quantity >= 25")), ("select * from lineitem where l_quantity > 25", "l_linenumber", lambda d: d.where("l_quantity > 25")))
_pair("mutation_lte_to_lt", "lineitem", ("select * from lineitem where l_quantity <= 25", "l_linenumber", lambda d: d.where("l_quantity <= 25")), ("select * from lineitem where l_quantity < 25", "l_linenumber", lambda d: d.where("l_quantity < 25")))
_pair(
    "mutation_sum_to_avg",
    "events",
    ("select user_id, cast(sum(cast(event_id as bigint)) as bigint) as v from events group by user_id", "v", lambda d: d.groupBy("user_id").agg(F.sum("event_id").alias("v"))),
    ("select user_id, cast(floor(avg(event_id)) as bigint) as v from events group by user_id", "v", lambda d: d.groupBy("user_id").agg(F.floor(F.avg("event_id")).alias("v"))),
)
_pair(
    "mutation_count_distinct_dropped",
    "events",
    ("select event_type, count(distinct user_id) as v from events group by event_type", "v", lambda d: d.groupBy("event_type").agg(F.count_distinct("user_id").alias("v"))),
    ("select event_type, count(user_id) as v from events group by event_type", "v", lambda d: d.groupBy("event_type").agg(F.count("user_id").alias("v"))),
)
_BOTH = "select user_id from events where event_type = 'click' {} select user_id from events where value > 50"
_pair(
    "mutation_union_all",
    "events",
    (_BOTH.format("union"), "user_id", lambda d: d.where("event_type = 'click'").select("user_id").union(d.where("value > 50").select("user_id")).distinct()),
    (_BOTH.format("union all"), "user_id", lambda d: d.where("event_type = 'click'").select("user_id").union(d.where("value > 50").select("user_id"))),
)
_NULLABLE = "case when o_orderkey % 12 <> 0 then o_custkey end"
_pair(
    "mutation_coalesce_dropped",
    "orders",
    (f"select coalesce({_NULLABLE}, -1) as v from orders", "v", lambda d: d.select(F.coalesce(F.expr(_NULLABLE), F.lit(-1)).alias("v"))),
    (f"select {_NULLABLE} as v from orders", "v", lambda d: d.select(F.expr(_NULLABLE).alias("v"))),
)
