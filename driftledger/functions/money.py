"""Money, signs and periods: the expression vocabulary of the ledger models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two values are equal within these bounds: totals, and cells of paired rows.
TOTAL_RELATIVE, TOTAL_ABSOLUTE, CELL_RELATIVE = 1e-12, 1e-9, 1e-9


def money(c: Column) -> Column:
    """The ledger's money type."""
    return c.cast("decimal(38,6)")


def minor_units(c: Column) -> Column:
    """Whole cents of a floating amount."""
    return F.round(c * 100).cast("long")


def signed(amount: Column, entry_type: Column) -> Column:
    """Debits count against, credits for."""
    return F.when(entry_type == "debit", -amount).otherwise(amount)


def period(day: Column) -> Column:
    """First day of the month."""
    return F.trunc(day, "month")


def total_moved(before: Column, after: Column) -> Column:
    """Whether a total moved; appearing and vanishing are moves."""
    b, a = before.cast("double"), after.cast("double")
    apart = F.abs(b - a) > F.greatest(F.lit(TOTAL_ABSOLUTE), TOTAL_RELATIVE * F.greatest(F.abs(b), F.abs(a)))
    return F.when(before.isNull() | after.isNull(), before.isNull() != after.isNull()).otherwise(apart)


def cell_changed(before: Column, after: Column, numeric: bool) -> Column:
    """Whether a paired cell changed: by tolerance for numbers, else by null-safe inequality."""
    if not numeric:
        return ~before.eqNullSafe(after)
    b, a = before.cast("double"), after.cast("double")
    apart = F.abs(b - a) > CELL_RELATIVE * F.greatest(F.abs(b), F.abs(a))
    return F.when(before.isNull() | after.isNull(), before.isNull() != after.isNull()).otherwise(apart)
