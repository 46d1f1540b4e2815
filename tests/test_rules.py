"""Golden cases: each rule fires on its defect, and reformatting fires none."""

import pytest

from driftledger.plans import cases
from driftledger.plans.cases import BASE, CASES, GRAINS, SNAPSHOTS, STANDING, WIDE
from driftledger.plans.rules import RULES, Config, Context, Revision, review


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    cases.views(spark)


def fired(spark, before, after, b=Config(), a=Config(), **context):
    x = Context("model", **({"grains": GRAINS, "snapshots": SNAPSHOTS} | context))
    found, skipped = review(Revision(spark.sql(before), before, b), Revision(spark.sql(after), after, a), x)
    assert not skipped, skipped
    return {f.rule_id for f in found}


@pytest.mark.parametrize("rule_id", CASES)
def test_rules(spark, rule_id):
    case = CASES[rule_id]
    found = lambda b, a: {f.rule_id for f in review(b, a, case.known())[0]}
    before, after = case.revisions(spark)
    assert rule_id in found(before, after)
    assert (rule_id in found(after, after)) == (rule_id in STANDING)


def test_near_misses(spark):
    assert "F6001" not in fired(spark, WIDE, BASE)
    assert "F7001" not in fired(spark, BASE, WIDE, a=Config(folder="staging/"))
    assert "F7004" not in fired(spark, BASE, BASE + " -- do not report this column in the extract")


def test_all_rules_are_there_and_controls_are_silent(spark):
    assert len(RULES) == 42 and set(CASES) == set(RULES)
    before = "select e.entry_id, sum(e.amount_usd) as total from entries e join contracts c on e.contract_id = c.contract_id where not e.flag group by e.entry_id"
    after = "SELECT x.entry_id, /* total */ SUM(x.amount_usd) AS total\nFROM entries x JOIN contracts k ON x.contract_id = k.contract_id\nWHERE NOT x.flag GROUP BY x.entry_id -- same"
    assert fired(spark, before, after) == set()


def test_a_rule_without_ground_is_skipped(spark):
    found, skipped = review(Revision(), Revision(spark.sql(BASE)), Context("model"))
    assert "F2001" in {s.rule_id for s in skipped}


def test_impact_reads_plans(spark):
    from driftledger.plans import impact

    text = "with e as (select * from entries) select e.entry_id, c.method from e join contracts c on e.contract_id = c.contract_id"
    assert impact.named_columns(spark, text) == {("entries", "entry_id"), ("contracts", "method"), ("entries", "contract_id"), ("contracts", "contract_id")}
    assert impact.named_columns(spark, "select * from entries") == set()
    inserted, removed = impact.edit_script(spark, BASE, BASE + " where flag")
    assert inserted["Filter"] == 1 and not removed and impact.edit_script(spark, BASE, BASE.upper().replace("SELECT", "select  ")) [0] is not None
    assert impact.edit_script(spark, BASE, "SELECT entry_id,   currency_code FROM entries") == ({}, {})
    assert impact.key_columns(spark, "concat(entry_id, '-', cast(period as string))") == ("entry_id", "period")
    assert impact.key_columns(spark, "e.entry_id || coalesce(currency_code, '')") == ("entry_id", "currency_code")
    assert impact.key_columns(spark, "rand() || entry_id") == ()
    histories = frozenset({"snap_contracts"})
    assert impact.keeps_versions(spark, "select * from snap_contracts", histories)
    assert impact.keeps_versions(spark, "select term, valid_from from snap_contracts", histories)
    assert not impact.keeps_versions(spark, "select term from snap_contracts where valid_to is null", histories)
    assert not impact.keeps_versions(spark, "select period as valid_from from entries", histories)
    cte = "with e as (select entry_id, amount_usd from entries) select entry_id, {} as a from e order by entry_id"
    assert impact.changed_outputs(spark, cte.format("amount_usd"), cte.format("amount_usd + 1")) == ("a",)
    assert impact.changed_outputs(spark, cte.format("amount_usd"), cte.format("amount_usd").replace("from entries", "from entries where flag")) is None
    assert impact.changed_outputs(spark, "select distinct entry_id from entries", "select distinct period from entries") is None
