"""Queries on plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import cases, catalyst, rules
from ..plans.ledger import Ledger
from . import query
from .ledger_sql import ledger

_MODELS = ("stg_fx_rates", "entity_reference", "account_activity", "dim_entities", "fct_revenue", "fct_account_period_summary", "fct_regulatory_summary", "fct_revenue_reported")


@query("plan_structural_grain", "select * from (values ('account_activity', ''), ('dim_entities', 'entity_code+entity_label'), ('entity_reference', 'entity_code'), ('fct_account_period_summary', 'account_id+period_month'), ('fct_regulatory_summary', 'currency_code+entity_code+period_month'), ('fct_revenue', ''), ('fct_revenue_reported', 'entity_code+period_month'), ('stg_fx_rates', '')) t(model, key)")
def plan_structural_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key that each model's plan proves; empty where nothing is proved."""
    ledger = Ledger(spark, sf_dir)
    rows = [(m, "+".join(min(catalyst.structural_keys(getattr(ledger, m)), key=len, default=()))) for m in _MODELS]
    return spark.createDataFrame(rows, "model string, key string")


#: Read off the models by hand: what each column's value is made of. The conversion takes its period through the rate's.
LINEAGE = (
    ("fct_revenue", "entry_id", "l_linenumber"),
    ("fct_revenue", "entry_id", "l_orderkey"),
    ("fct_revenue", "account_id", "o_custkey"),
    ("fct_revenue", "entity_code", "n_name"),
    ("fct_revenue", "currency_code", "n_regionkey"),
    ("fct_revenue", "period_month", "o_orderdate"),
    ("fct_revenue", "recognition", "s_suppkey"),
    ("fct_revenue", "revenue_usd_e4", "l_extendedprice"),
    ("fct_revenue", "revenue_usd_e4", "l_returnflag"),
    ("fct_revenue", "revenue_usd_e4", "o_orderdate"),
    ("fct_revenue", "revenue_usd_e4", "r_regionkey"),
    ("fct_regulatory_summary", "period_month", "o_orderdate"),
    ("fct_regulatory_summary", "entity_code", "n_name"),
    ("fct_regulatory_summary", "currency_code", "n_regionkey"),
    ("fct_regulatory_summary", "account_count", "o_custkey"),
    ("fct_regulatory_summary", "amount_minor", "l_extendedprice"),
    ("fct_regulatory_summary", "amount_minor", "l_returnflag"),
    ("fct_regulatory_summary", "revenue_usd_e4", "l_extendedprice"),
    ("fct_regulatory_summary", "revenue_usd_e4", "l_returnflag"),
    ("fct_regulatory_summary", "revenue_usd_e4", "o_orderdate"),
    ("fct_regulatory_summary", "revenue_usd_e4", "r_regionkey"),
)


@query("plan_column_lineage", "select * from (values " + ", ".join(map(str, LINEAGE)) + ") t(model, \"column\", source)")
def plan_column_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    rows = [(m, c, s) for m in ("fct_revenue", "fct_regulatory_summary") for c, found in catalyst.lineage(getattr(ledger, m)).items() for s in sorted(found)]
    return spark.createDataFrame(rows, "model string, column string, source string")


@query("plan_rules", "select * from (values " + ", ".join(f"('{r}', true, {str(r in cases.STANDING).lower()})" for r in sorted(cases.CASES)) + ") t(rule_id, on_defect, unchanged)")
def plan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of the rules fires on its defect, and on a revision without a change; only plans are read."""
    cases.views(spark)
    out = []
    for rule_id, case in cases.CASES.items():
        b, a = case.revisions(spark)
        fired = lambda p, q: any(f.rule_id == rule_id for f in rules.review(p, q, case.known())[0])  # noqa: B023, E731
        out.append((rule_id, fired(b, a), fired(a, a)))
    return spark.createDataFrame(out, "rule_id string, on_defect boolean, unchanged boolean")


#: Edits of the ledger, the model whose plan each touches, and the rules that should speak of it.
CORPUS = (
    ("none", "revenue_recognized", ""), ("fx_any_period", "entries_converted", "F1001"), ("contract_inner", "revenue_recognized", "F1002"), ("with_intercompany", "revenue_recognized", "F2001"),
    ("with_reversals", "revenue_recognized", "F2001"), ("either_filter", "revenue_recognized", "F2001"), ("no_default", "revenue_recognized", ""), ("period_from_posting", "stg_entries", ""),
)
_FIGURES = "count(*) as n, cast(sum(revenue_usd_e4) as bigint) as total, count(recognition) as known, count_if(recognition = 'ratable') as ratable, cast(sum(date_diff('day', date '1990-01-01', period_month)) as bigint) as days"


def _corpus_sql() -> str:
    one = lambda e: f"(with {ledger(*([e] if e != 'none' else []))} select {_FIGURES} from fct_revenue)"
    return " union all ".join(f"select '{e}' as edit, '{m}' as model, (h.n, h.total, h.known, h.ratable, h.days) is distinct from (b.n, b.total, b.known, b.ratable, b.days) as moved, '{r}' as rules from {one('none')} b, {one(e)} h" for e, m, r in CORPUS)


@query("corpus_measured", _corpus_sql())
def corpus_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every edit whether it moves figures of the revenue mart, which is the truth, and which rules speak of it."""

    def figures(ledger_: Ledger) -> DataFrame:
        return ledger_.fct_revenue.agg(
            F.count(F.lit(1)).alias("n"), F.sum("revenue_usd_e4").alias("total"), F.count("recognition").alias("known"), F.count_if(F.col("recognition") == "ratable").alias("ratable"),
            F.sum(F.datediff("period_month", F.lit("1990-01-01"))).cast("long").alias("days"),
        ).select(F.struct("*").alias("figures"))

    base, out = Ledger(spark, sf_dir), None
    before = figures(base).withColumnRenamed("figures", "before")
    context = {"grains": {"stg_fx_rates": ("currency_code", "rate_period"), "stg_contracts": ("contract_id",)}}
    for edit, model, _ in CORPUS:
        head = Ledger(spark, sf_dir, *([edit] if edit != "none" else []))
        found, _ = rules.review(rules.Revision(getattr(base, model)), rules.Revision(getattr(head, model)), rules.Context(model, **context))
        one = figures(head).crossJoin(before)  # one row a side
        one = one.select(F.lit(edit).alias("edit"), F.lit(model).alias("model"), (~F.col("figures").eqNullSafe(F.col("before"))).alias("moved"), F.lit(",".join(sorted({f.rule_id for f in found}))).alias("rules"))
        out = one if out is None else out.unionByName(one)
    return out
