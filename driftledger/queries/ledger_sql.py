"""The ledger in SQL, with the same edits as plans.ledger, for comparison."""

from __future__ import annotations


def ledger(*edits: str, suffix: str = "") -> str:
    """Common table expressions of all models, without the leading WITH; names end in ``suffix``."""
    s, e = suffix, set(edits)
    ccy = "list_extract(['USD','EUR','GBP','SGD','JPY'], {}+1)"
    day = "l_shipdate" if "period_from_posting" in e else "o_orderdate"
    fx = "a.currency_code = r.currency_code" + ("" if "fx_any_period" in e else " and n.period_month = r.rate_period")
    external = "true" if "with_intercompany" in e else "not is_intercompany"
    booked = "true" if "with_reversals" in e else "not is_reversal"
    op = "or" if "either_filter" in e else "and"
    kind = "join" if "contract_inner" in e else "left join"
    recognition = "recognition_method" if "no_default" in e else "coalesce(recognition_method, 'point_in_time')"
    return f"""
lines{s} as (select * exclude (rn) from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as rn from lineitem) where rn = 1),
stg_accounts{s} as (select c_custkey as account_id, c_name as account_name, c_mktsegment as account_type, n_name as entity_code, {ccy.format("n_regionkey")} as currency_code, c_custkey % 7 = 0 as is_intercompany from customer join nation on c_nationkey = n_nationkey),
stg_contracts{s} as (select 'C' || s_suppkey as contract_id, case when s_suppkey % 2 = 0 then 'ratable' else 'point_in_time' end as recognition_method, s_suppkey % 36 + 1 as term_months from supplier),
stg_fx_rates{s} as (select {ccy.format("r_regionkey")} as currency_code, rate_period, cast(100 + (r_regionkey * 13 + month(rate_period) * 7) % 11 as bigint) as rate_pct from (select distinct cast(date_trunc('month', o_orderdate) as date) as rate_period from orders), region),
stg_entries{s} as (select l_orderkey || '-' || l_linenumber as entry_id, o_custkey as account_id, cast(l_shipdate as date) as posting_date, cast(date_trunc('month', {day}) as date) as period_month,
  case when l_returnflag = 'R' then 'debit' else 'credit' end as entry_type, case when l_returnflag = 'R' then -1 else 1 end * cast(round(l_extendedprice * 100) as bigint) as amount_minor,
  case when l_partkey % 12 = 0 then null when l_partkey % 25 = 1 then 'orphan' else 'C' || l_suppkey end as contract_id, l_returnflag = 'A' and l_linestatus = 'F' as is_reversal
  from lines{s} join orders on l_orderkey = o_orderkey),
entity_reference{s} as (select entity_code, 'ENT-' || entity_code as entity_ref, count(*) as n_accounts from stg_accounts{s} group by entity_code),
entries_converted{s} as (select n.*, a.currency_code, a.entity_code, a.is_intercompany, r.rate_pct, n.amount_minor * r.rate_pct as amount_usd_e4 from stg_entries{s} n join stg_accounts{s} a on n.account_id = a.account_id join stg_fx_rates{s} r on {fx}),
revenue_recognized{s} as (select e.*, recognition_method, term_months, {recognition} as recognition from entries_converted{s} e {kind} stg_contracts{s} c on e.contract_id = c.contract_id where {external} {op} {booked}),
account_activity{s} as (select account_id, period_month, count(*) as entry_count, cast(sum(amount_usd_e4) as bigint) as amount_usd_e4, 'posted' as activity_type from entries_converted{s} where not is_reversal group by account_id, period_month
  union all select account_id, period_month, count(*), cast(sum(amount_usd_e4) as bigint), 'reversed' from entries_converted{s} where is_reversal group by account_id, period_month),
dim_entities{s} as (select distinct entity_code, case when entity_code in ('FRANCE', 'GERMANY', 'UNITED KINGDOM') then 'Core ' || entity_code else entity_code end as entity_label from stg_accounts{s}),
fct_revenue{s} as (select entry_id, account_id, entity_code, currency_code, period_month, recognition, amount_usd_e4 as revenue_usd_e4 from revenue_recognized{s}),
fct_account_period_summary{s} as (select account_id, period_month, cast(sum(entry_count) as bigint) as entry_count, cast(sum(amount_usd_e4) as bigint) as net_usd_e4 from account_activity{s} group by account_id, period_month),
fct_regulatory_summary{s} as (select period_month, entity_code, currency_code, count(*) as entry_count, count(distinct account_id) as account_count, cast(sum(amount_minor) as bigint) as amount_minor, cast(sum(amount_usd_e4) as bigint) as revenue_usd_e4 from revenue_recognized{s} group by period_month, entity_code, currency_code),
fct_revenue_reported{s} as (select period_month, entity_code, cast(round(cast(sum(revenue_usd_e4) as decimal(28,4)) / cast(100 as decimal(3,0))) as bigint) as revenue_cents from fct_revenue{s} group by period_month, entity_code)
"""


def select(body: str, *edits: str) -> str:
    return f"with {ledger(*edits)} {body}"


def both(body: str, *edits: str) -> str:
    """The unedited ledger as name_b and the edited one as name_h."""
    return f"with {ledger(suffix='_b')}, {ledger(*edits, suffix='_h')} {body}"
