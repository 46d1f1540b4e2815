"""Every registered query of the ledger engine against its SQL, at the smallest scale."""

import pytest

import __spark_entry__
from driftledger import queries as core

from .oracle import connect, compare

FOLDER = "/root/testdata/sf0.001"
core.load()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_equals_sql(spark, duck, name):
    compare(core.QUERIES[name](spark, FOLDER), duck, core.ORACLES[name])


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    moved = {r.column_name: r for r in rows}
    assert moved["revenue_usd_e4"].changed > 0 and moved["revenue_usd_e4"].rows_before == moved["revenue_usd_e4"].rows_after


def test_all_keys_are_unique_and_have_sql():
    assert set(core.ORACLES) == set(core.QUERIES) and set(core.QUERIES) <= set(__spark_entry__.queries())
