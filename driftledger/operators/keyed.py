"""Pairing two builds of a table on a key that is counted unique in both, and what changed between the pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.money import cell_changed
from .measure import IGNORED, grain


class KeyedDiff:
    """One full outer equi-join; every count, sample and period figure is an aggregate over its rows.

    The join is on plain equality, which the engine hashes or sorts; keys with nulls are refused beforehand, so that
    nothing is lost by it. Columns of map type cannot be compared and are left out, as are the ignored ones.
    """

    def __init__(self, base: DataFrame, head: DataFrame, keys: list[str], ignored: tuple[str, ...] = IGNORED):
        shared = [c for c in base.columns if c in head.columns]
        types = {f.name: f.dataType for f in base.schema}
        self.keys = keys
        self.skipped = [c for c in shared if c.lower() in ignored or types[c].typeName() == "map"]
        self.columns = [c for c in shared if c not in keys and c not in self.skipped]
        numeric = {c: isinstance(types[c], NumericType) for c in self.columns}
        b = base.select(*keys, *(F.col(c).alias(f"b_{c}") for c in self.columns), F.lit(True).alias("in_base"))
        h = head.select(*keys, *(F.col(c).alias(f"h_{c}") for c in self.columns), F.lit(True).alias("in_head"))
        joined = b.join(h, keys, "full_outer")
        paired = F.col("in_base").isNotNull() & F.col("in_head").isNotNull()
        flags = {f"changed_{c}": F.when(paired, cell_changed(F.col(f"b_{c}"), F.col(f"h_{c}"), numeric[c])).otherwise(False) for c in self.columns}
        side = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "removed").otherwise("paired")
        self.rows = joined.withColumns(flags | {"side": side})

    @property
    def any_changed(self) -> Column:
        return reduce(lambda a, b: a | b, (F.col(f"changed_{c}") for c in self.columns), F.lit(False))

    def counts(self) -> DataFrame:
        """(added, removed, changed, paired)."""
        side = F.col("side")
        return self.rows.agg(
            F.count_if(side == "added").alias("added"), F.count_if(side == "removed").alias("removed"),
            F.count_if(self.any_changed).alias("changed"), F.count_if(side == "paired").alias("paired"),
        )

    def by_column(self) -> DataFrame:
        """(column_name, changed) for every compared column, from the same single pass."""
        row = self.rows.agg(*(F.count_if(F.col(f"changed_{c}")).alias(c) for c in self.columns))
        return row.unpivot([], self.columns, "column_name", "changed")

    def sample(self, n: int = 5) -> DataFrame:
        """(key_text, side) of the first changed, added or removed keys by their text."""
        text = F.concat_ws(" | ", *(F.col(k).cast("string") for k in self.keys))
        return self.rows.where((F.col("side") != "paired") | self.any_changed).select(text.alias("key_text"), "side").orderBy("key_text", "side").limit(n)

    def periods(self, period: str) -> DataFrame:
        """(latest_period, prior_rows, earliest_changed): rows moved in periods before the latest one of either build.

        ``period`` is a key column. A row that was added or removed moved too.
        """
        moved = (F.col("side") != "paired") | self.any_changed
        per = self.rows.groupBy(period).agg(F.count_if(moved).alias("moved"))
        latest = per.agg(F.max(period).alias("latest"))
        joined = per.crossJoin(F.broadcast(latest))
        return joined.agg(
            F.max("latest").cast("string").alias("latest_period"),
            F.coalesce(F.sum(F.when(F.col(period) < F.col("latest"), F.col("moved"))), F.lit(0)).cast("long").alias("prior_rows"),
            F.min(F.when(F.col("moved") > 0, F.col(period))).cast("string").alias("earliest_changed"),
        )


def refusal(base: DataFrame, head: DataFrame, keys: list[str], most_rows: int | None = None) -> DataFrame:
    """(reason): why two tables are not paired, or null; refused in the order in which they are listed here.

    A budget of rows is the caller's wish; without one, tables of any size are paired.
    """
    if not keys:
        return base.sparkSession.createDataFrame([("no key is known",)], "reason string")
    b, h = (grain(df, keys).select(*(F.col(c).alias(f"{p}_{c}") for c in ("row_count", "key_count", "null_key_rows"))) for df, p in ((base, "b"), (head, "h")))
    reason = (
        F.when(F.col("h_row_count") != F.col("h_key_count"), "key repeats in head")
        .when(F.col("b_row_count") != F.col("b_key_count"), "key repeats in base")
        .when(F.lit(False) if most_rows is None else F.greatest("b_row_count", "h_row_count") > most_rows, "over the row budget")
        .when((F.col("b_null_key_rows") > 0) | (F.col("h_null_key_rows") > 0), "nulls in the key")
    )
    return b.crossJoin(h).select(reason.alias("reason"))  # one row a side
