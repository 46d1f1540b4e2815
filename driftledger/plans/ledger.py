"""The ledger: staging, conversion, recognition and marts as composable frames over the source tables.

Two ledgers over the same sources, one of them with edits, are the two revisions that the differ compares. Amounts are
whole minor units and converted ones whole ten-thousandths, so that totals are exact.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import minor_units, period, signed
from ..sources.tables import table

#: A currency for each region, in the order of r_regionkey.
CURRENCIES = ("USD", "EUR", "GBP", "SGD", "JPY")
LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

#: Model -> models that it reads; the graph that the graph operators are shown on.
EDGES = (
    ("raw_accounts", "stg_accounts"), ("raw_contracts", "stg_contracts"), ("raw_contracts", "snap_contracts"), ("raw_fx_rates", "stg_fx_rates"),
    ("raw_fx_rates", "snap_fx_rates"), ("raw_accounts", "snap_accounts"), ("raw_gl_entries", "stg_entries"), ("stg_accounts", "entity_reference"),
    ("stg_entries", "entries_converted"), ("stg_fx_rates", "entries_converted"), ("entries_converted", "revenue_recognized"),
    ("stg_accounts", "revenue_recognized"), ("stg_contracts", "revenue_recognized"), ("entries_converted", "account_activity"),
    ("revenue_recognized", "fct_revenue"), ("revenue_recognized", "fct_revenue_incremental"), ("account_activity", "fct_account_period_summary"),
    ("revenue_recognized", "fct_regulatory_summary"), ("fct_revenue", "fct_revenue_reported"), ("stg_accounts", "dim_accounts"),
    ("stg_accounts", "dim_entities"), ("dim_entities", "dim_entity_contract"), ("snap_contracts", "dim_contract_terms"), ("snap_fx_rates", "dim_fx_rates_current"),
)


class Ledger:
    """Every model is built on first use. ``edits`` names the changes of a revision:

    fx_any_period (the rate join forgets the period), contract_inner (contracts joined inner), with_intercompany,
    with_reversals, either_filter (the two conditions of revenue joined by or), no_default (recognition without its
    default), period_from_posting.
    """

    EDITS = frozenset({"fx_any_period", "contract_inner", "with_intercompany", "with_reversals", "either_filter", "no_default", "period_from_posting"})

    def __init__(self, spark: SparkSession, sf_dir: str, *edits: str):
        if unknown := set(edits) - self.EDITS:
            raise ValueError(f"unknown edits: {sorted(unknown)}")
        self.spark, self.sf_dir, self.edits = spark, sf_dir, frozenset(edits)

    def source(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def lines(self) -> DataFrame:
        """Lines without repeats of their key; the order of all other columns decides which stays, before the shuffle where it can."""
        first = F.min(F.struct(*LINE_COLUMNS[2:])).alias("first")
        return self.source("lineitem").groupBy(*LINE_COLUMNS[:2]).agg(first).select(*LINE_COLUMNS[:2], "first.*")

    @cached_property
    def stg_accounts(self) -> DataFrame:
        nation = self.source("nation")
        return self.source("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("account_id"),
            F.col("c_name").alias("account_name"),
            F.col("c_mktsegment").alias("account_type"),
            F.col("n_name").alias("entity_code"),
            F.element_at(F.array(*map(F.lit, CURRENCIES)), F.col("n_regionkey") + 1).alias("currency_code"),
            (F.col("c_custkey") % 7 == 0).alias("is_intercompany"),
        )

    @cached_property
    def stg_contracts(self) -> DataFrame:
        return self.source("supplier").select(
            F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("contract_id"),
            F.when(F.col("s_suppkey") % 2 == 0, "ratable").otherwise("point_in_time").alias("recognition_method"),
            (F.col("s_suppkey") % 36 + 1).alias("term_months"),
        )

    @cached_property
    def stg_fx_rates(self) -> DataFrame:
        """One rate a currency and month, in hundredths."""
        months = self.source("orders").select(period(F.col("o_orderdate").cast("date")).alias("rate_period")).distinct()
        rate = 100 + (F.col("r_regionkey") * 13 + F.month("rate_period") * 7) % 11
        code = F.element_at(F.array(*map(F.lit, CURRENCIES)), F.col("r_regionkey") + 1)
        return months.crossJoin(F.broadcast(self.source("region"))).select(code.alias("currency_code"), "rate_period", rate.cast("long").alias("rate_pct"))

    @cached_property
    def stg_entries(self) -> DataFrame:
        contract = F.when(F.col("l_partkey") % 12 == 0, None).when(F.col("l_partkey") % 25 == 1, "orphan").otherwise(F.concat(F.lit("C"), F.col("l_suppkey").cast("string")))
        day = F.col("l_shipdate" if "period_from_posting" in self.edits else "o_orderdate").cast("date")
        kind = F.when(F.col("l_returnflag") == "R", "debit").otherwise("credit")
        orders = self.source("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return self.lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("entry_id"),
            F.col("o_custkey").alias("account_id"),
            F.col("l_shipdate").cast("date").alias("posting_date"),
            period(day).alias("period_month"),
            kind.alias("entry_type"),
            signed(minor_units(F.col("l_extendedprice")), kind).alias("amount_minor"),
            contract.alias("contract_id"),
            ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("is_reversal"),
        )

    @cached_property
    def entity_reference(self) -> DataFrame:
        one = self.stg_accounts.groupBy("entity_code").agg(F.count(F.lit(1)).alias("n_accounts"))
        return one.select("entity_code", F.concat(F.lit("ENT-"), F.col("entity_code")).alias("entity_ref"), "n_accounts")

    @cached_property
    def entries_converted(self) -> DataFrame:
        account = self.stg_accounts.select("account_id", "currency_code", "entity_code", "is_intercompany")
        rate = self.stg_fx_rates
        entry = self.stg_entries.join(account, "account_id")
        if "fx_any_period" in self.edits:
            joined = entry.join(rate.drop("rate_period").alias("stg_fx_rates"), "currency_code")
        else:
            joined = entry.join(rate.withColumnRenamed("rate_period", "period_month").alias("stg_fx_rates"), ["currency_code", "period_month"])
        return joined.withColumn("amount_usd_e4", F.col("amount_minor") * F.col("rate_pct"))

    @cached_property
    def revenue_recognized(self) -> DataFrame:
        external, booked = ~F.col("is_intercompany"), ~F.col("is_reversal")
        if "with_intercompany" in self.edits:
            external = F.lit(True)
        if "with_reversals" in self.edits:
            booked = F.lit(True)
        condition = external | booked if "either_filter" in self.edits else external & booked
        joined = self.entries_converted.where(condition).join(self.stg_contracts.alias("stg_contracts"), "contract_id", "inner" if "contract_inner" in self.edits else "left")
        recognition = F.col("recognition_method") if "no_default" in self.edits else F.coalesce("recognition_method", F.lit("point_in_time"))
        return joined.withColumn("recognition", recognition)

    @cached_property
    def account_activity(self) -> DataFrame:
        def part(condition: str, kind: str) -> DataFrame:
            rows = self.entries_converted.where(condition).groupBy("account_id", "period_month")
            return rows.agg(F.count(F.lit(1)).alias("entry_count"), F.sum("amount_usd_e4").alias("amount_usd_e4")).withColumn("activity_type", F.lit(kind))

        return part("not is_reversal", "posted").unionByName(part("is_reversal", "reversed"))

    @cached_property
    def dim_entities(self) -> DataFrame:
        nations = ("FRANCE", "GERMANY", "UNITED KINGDOM")
        label = F.when(F.col("entity_code").isin(*nations), F.concat(F.lit("Core "), F.col("entity_code"))).otherwise(F.col("entity_code"))
        return self.stg_accounts.select("entity_code", label.alias("entity_label")).distinct()

    @cached_property
    def fct_revenue(self) -> DataFrame:
        return self.revenue_recognized.select("entry_id", "account_id", "entity_code", "currency_code", "period_month", "recognition", F.col("amount_usd_e4").alias("revenue_usd_e4"))

    @cached_property
    def fct_account_period_summary(self) -> DataFrame:
        rows = self.account_activity.groupBy("account_id", "period_month")
        return rows.agg(F.sum("entry_count").alias("entry_count"), F.sum("amount_usd_e4").alias("net_usd_e4"))

    @cached_property
    def fct_regulatory_summary(self) -> DataFrame:
        rows = self.revenue_recognized.groupBy("period_month", "entity_code", "currency_code")
        return rows.agg(
            F.count(F.lit(1)).alias("entry_count"),
            F.count_distinct("account_id").alias("account_count"),
            F.sum("amount_minor").alias("amount_minor"),
            F.sum("amount_usd_e4").alias("revenue_usd_e4"),
        )

    @cached_property
    def fct_revenue_reported(self) -> DataFrame:
        """Rounded to whole cents for presentation."""
        rows = self.fct_revenue.groupBy("period_month", "entity_code").agg(F.sum("revenue_usd_e4").alias("e4"))
        return rows.select("period_month", "entity_code", F.round(F.col("e4").cast("decimal(28,4)") / F.lit(100).cast("decimal(3,0)")).cast("long").alias("revenue_cents"))
