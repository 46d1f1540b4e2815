"""Names that mark what a column or a model holds, and their classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of lower-cased column names, by what they mark.
HINTS: dict[str, tuple[str, ...]] = {
    "monetary": ("amount", "amt", "price", "cost", "revenue", "balance", "value", "total", "fee", "tax", "charge", "payment", "salary", "rate", "usd", "eur", "gbp", "sgd"),
    "sensitive": ("email", "phone", "address", "postcode", "zipcode", "ssn", "nric", "passport", "dob", "birth", "salary", "national_id", "tax_id", "account_number", "iban", "card_number", "full_name", "first_name", "last_name"),
    "currency": ("currency", "ccy_code", "curr_code", "iso_currency"),
    "transaction_currency": ("txn_ccy", "trade_ccy", "local_ccy", "local_amount", "amount_lcy", "original_amount", "source_amount"),
    "reporting_currency": ("_usd", "_eur", "_gbp", "_chf", "_jpy", "_base_ccy", "_reporting_ccy", "_rpt_ccy"),
    "period": ("period", "month", "quarter", "fiscal", "as_of", "asof", "reporting_date", "business_date", "cob_date", "value_date"),
    "minor_unit": ("_minor", "_cents", "_pence", "_sen", "minor_units"),
}
GOVERNED_TAGS = ("regulatory", "recon", "control")
PUBLISHED_FOLDERS = ("marts/", "reporting/", "published/", "exposed/")
HIVE_CATALOGS = ("hive",)


def pattern(kind: str) -> str:
    return "|".join(HINTS[kind])


def marks(column: Column, kind: str) -> Column:
    """Whether a column name holds a hint; a reporting currency overrules a transaction one."""
    found = F.lower(column).rlike(pattern(kind))
    return found & ~F.lower(column).rlike(pattern("reporting_currency")) if kind == "transaction_currency" else found


def is_marked(name: str, kind: str) -> bool:
    low = name.lower()
    found = any(h in low for h in HINTS[kind])
    return found and not any(h in low for h in HINTS["reporting_currency"]) if kind == "transaction_currency" else found


def is_governed(tags: Column) -> Column:
    return F.arrays_overlap(F.transform(tags, F.lower), F.array(*map(F.lit, GOVERNED_TAGS)))
