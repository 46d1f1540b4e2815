"""Operators on small tables with awkward rows."""

import pytest
from pyspark.sql import functions as F

from driftledger.functions import text as T
from driftledger.operators import graph, incremental, measure
from driftledger.operators.history import HistoryConfig, as_of, current, first_snapshot, snapshot
from driftledger.operators.keyed import KeyedDiff, refusal
from driftledger.plans import catalyst
from driftledger.plans.ledger import Ledger

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "entry_id string, period int, recognition string, amount double, _loaded_at timestamp"
BASE = [("E1", 1, "point_in_time", 100.0), ("E2", 1, "point_in_time", 0.1 + 0.2), ("E3", 1, "over_time", 50.0), ("E4", 1, "point_in_time", 10.0)]
HEAD = [("E1", 1, "over_time", 100.0), ("E2", 1, "point_in_time", 0.3), ("E3", 1, "over_time", None), ("E5", 1, "point_in_time", 10.0)]
KEYS = ["entry_id", "period"]


@pytest.fixture(scope="module")
def builds(spark):
    at = lambda rows, day: spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumn("_loaded_at", F.lit(day).cast("timestamp"))
    return at(BASE, "2026-01-01"), at(HEAD, "2026-01-02")


def test_keyed_diff(builds):
    d = KeyedDiff(*builds, KEYS)
    assert tuple(d.counts().first()) == (1, 1, 2, 3)
    assert {r.column_name: r.changed for r in d.by_column().collect()} == {"recognition": 1, "amount": 1}
    assert d.skipped == ["_loaded_at"] and "E1 | 1" in {r.key_text for r in d.sample().collect()}


def test_pairing_is_an_equi_join(builds):
    plan = KeyedDiff(*builds, KEYS).counts()._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_restatement(spark):
    rows = lambda *v: spark.createDataFrame([(m, e, float(x)) for (m, e), x in zip([("2026-06", "A"), ("2026-06", "B"), ("2026-07", "A"), ("2026-08", "B")], v, strict=True)], "period_month string, entity string, revenue double")
    d = lambda head: tuple(KeyedDiff(rows(1, 2, 3, 4), head, ["period_month", "entity"]).periods("period_month").first())
    assert d(rows(1, 999, 3, 888)) == ("2026-08", 1, "2026-06")
    assert d(rows(1, 2, 3, 888)) == ("2026-08", 0, "2026-08")
    assert d(rows(1, 2, 3, 4)) == ("2026-08", 0, None)


def test_refusals(spark, builds):
    nulls = spark.createDataFrame([("E1", 1), (None, 1)], "entry_id string, period int")
    assert refusal(nulls, nulls, KEYS).first().reason == "nulls in the key"
    assert refusal(*builds, ["period"]).first().reason == "key repeats in head"
    assert refusal(*builds, []).first().reason == "no key is known"
    assert refusal(*builds, KEYS).first().reason is None


def test_measures(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (1, 2)], "a int, b int")
    assert df.agg(measure.distinct_keys(["a", "b"]).alias("n")).first().n == 2
    g = measure.grain(df, ["a", "b"]).first()
    assert (g.row_count, g.key_count, g.null_key_rows, g.is_unique) == (3, 2, 1, False)
    assert measure.null_rates(df.limit(0), ["a"]).first().a is None
    assert measure.grain(df.limit(0), ["a"]).first().rows_per_key is None


def test_totals_have_a_tolerance(spark):
    from driftledger.functions.money import total_moved

    row = lambda a, b: spark.range(1).select(total_moved(F.lit(a), F.lit(b)).alias("m")).first().m
    assert not row(1e15, 1e15 + 0.5) and row(1.0, 1.0001) and row(None, 1.0)
    assert not spark.range(1).select(total_moved(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("m")).first().m


@pytest.mark.parametrize(("deletes", "versions", "now"), [("ignore", 4, 3), ("invalidate", 4, 2), ("new_record", 5, 2)])
def test_history(spark, deletes, versions, now):
    schema = "id int, name string, updated_at date"
    day = lambda n: F.lit(f"2026-01-0{n}").cast("date")
    source = lambda *rows: spark.createDataFrame([(i, n, None, u) for i, n, u in rows], "id int, name string, d string, u string").select("id", "name", F.col("u").cast("date").alias("updated_at"))
    config = HistoryConfig(("id",), "timestamp", "updated_at", deletes=deletes)
    h = first_snapshot(source((1, "a", "2026-01-01"), (2, "b", "2026-01-01")), config, day(1))
    h = snapshot(h, source((1, "a2", "2026-01-02"), (3, "c", "2026-01-02")), config, day(2))
    assert h.count() == versions and current(h).count() == now and schema
    facts = source((1, "", "2026-01-01"), (1, "", "2026-01-05")).select("id", F.col("updated_at").alias("day"))
    assert sorted(r.name for r in as_of(facts, h, "id", "day").select(h["name"]).collect()) == ["a", "a2"]


def test_incremental(spark):
    target = spark.createDataFrame([(1, "p", 1), (2, "p", 2), (3, "q", 3)], "k int, part string, v int")
    batch = spark.createDataFrame([(2, "p", 20), (4, "p", 4)], "k int, part string, v int")
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "part", "v").collect())
    assert len(rows(incremental.append(target, batch))) == 5
    assert rows(incremental.delete_insert(target, batch, ["k"])) == rows(incremental.merge(target, batch, ["k"])) == [(1, "p", 1), (2, "p", 20), (3, "q", 3), (4, "p", 4)]
    assert rows(incremental.overwrite_partitions(target, batch, ["part"])) == [(2, "p", 20), (3, "q", 3), (4, "p", 4)]
    with pytest.raises(Exception, match="several rows"):
        incremental.merge(target, batch.union(batch), ["k"]).collect()


def test_partition_overwrite_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "v int, part string")
    incremental.write_partitions(rows, str(tmp_path), ["part"])
    incremental.write_partitions(spark.createDataFrame([(3, "p")], "v int, part string"), str(tmp_path), ["part"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path)).select("v", "part").collect()) == [(2, "q"), (3, "p")]


@pytest.mark.parametrize("few", [0, 1000])
def test_graph_survives_cycles(spark, few):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "parent string, child string")
    found = {(r.ancestor, r.descendant): r.depth for r in graph.closure(edges, few=few).collect()}
    assert found["a", "c"] == 1 and found["b", "a"] == 2 and found["a", "a"] == 2
    assert {r.level for r in graph.levels(edges, few).collect()} == {None}


@pytest.mark.parametrize("few", [0, 1000])
def test_long_chains_are_walked_to_their_end(spark, few):
    chain = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(20)] + [("n00", "n15")], "parent string, child string")
    found = {(r.ancestor, r.descendant): r.depth for r in graph.closure(chain, few=few).collect()}
    assert len(found) == 210 and found["n00", "n20"] == 6
    assert {r.name: r.level for r in graph.levels(chain, few).collect()} == {f"n{k:02}": k for k in range(21)}
    start = spark.createDataFrame([("n18",), ("n20",), ("absent",)], "name string")
    assert sorted(tuple(r) for r in graph.reach(chain, start, few).collect()) == [("n18", "n19", 1), ("n18", "n20", 2)]


def test_plans(spark):
    ledger = Ledger(spark, FOLDER)
    ranked = ledger.stg_entries.select("account_id", "entry_id", F.expr("row_number() over (partition by account_id order by entry_id)").alias("rn"))
    assert catalyst.structural_keys(ranked.where("rn = 1")) == [("account_id",)] and catalyst.structural_keys(ranked.where("rn <= 2")) == []
    assert catalyst.same_sql(spark, "select a from t -- x", "SELECT  a\nFROM t") and not catalyst.same_sql(spark, "select a from t", "select b from t")
    stamped = spark.range(3).select("id", F.current_timestamp().alias("at"), F.current_date().alias("day")).withColumn("later", F.col("at") + F.expr("interval 1 day"))
    assert catalyst.volatile_columns(stamped) == {"at", "later"}
    with pytest.raises(ValueError, match="unknown edits"):
        Ledger(spark, FOLDER, "typo")


def test_texts(spark):
    df = spark.createDataFrame([("a", "x\nselect one two\nthree four\ny"), ("b", "one two three\nz\none two three")], "file string, text string")
    found = {r.file: (r.first_line, r.last_line) for r in T.locate(df, "one two three").collect()}
    assert found == {"a": (2, 3)}
    keys = spark.createDataFrame([("USD", 1, 1.5), ("USD", 2, 1.5), ("EUR", 1, 2.5)], "code string, month int, rate double")
    assert [tuple(r) for r in T.seed_keys(keys).collect()] == [("code+month", 2)]


def test_manifest(spark, tmp_path):
    from driftledger.sources.tables import manifest, run_results, seed

    (tmp_path / "m.json").write_text('{"nodes": {"model.p.a": {"name": "a", "resource_type": "model", "depends_on": {"nodes": ["seed.p.s"]}}, "seed.p.s": {"name": "s", "resource_type": "seed"}, "test.p.t": {"name": "t", "resource_type": "test", "depends_on": {"nodes": ["model.p.a"]}, "test_metadata": {"name": "unique", "kwargs": {"column_name": "id"}}}}}')
    m = manifest(spark, str(tmp_path / "m.json"))
    assert m["nodes"].count() == 2 and [tuple(r) for r in m["edges"].collect()] == [("seed.p.s", "model.p.a")]
    assert [tuple(r) for r in m["tests"].collect()] == [("model.p.a", "unique", "id")]
    (tmp_path / "r.json").write_text('{"results": [{"unique_id": "model.p.a", "status": "success"}, {"unique_id": "test.p.t", "status": "fail"}]}')
    assert [tuple(r) for r in run_results(spark, str(tmp_path / "r.json")).collect()] == [("a", "success")]
    (tmp_path / "s.csv").write_text("id,v\n1,x\n2\n")
    assert [tuple(r) for r in seed(spark, str(tmp_path / "s.csv"), "id int, v string").collect()] == [(1, "x"), (2, None)]


def test_streams(spark, tmp_path):
    from driftledger.streaming.incremental import history_sink, run_to_end

    source, root = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate(([(1, "a", "2026-01-01")], [(1, "b", "2026-01-02"), (2, "c", "2026-01-02")])):
        spark.createDataFrame(rows, "id int, name string, u string").select("id", "name", F.col("u").cast("date").alias("updated_at")).coalesce(1).write.mode("append").parquet(str(source / f"d={k}"))
    stream = spark.readStream.schema("id int, name string, updated_at date").option("maxFilesPerTrigger", 1).parquet(f"{source}/d=*")
    config = HistoryConfig(("id",), "timestamp", "updated_at")
    run_to_end(stream, str(tmp_path / "cp"), history_sink(spark, str(root), config, lambda e: F.lit("2026-01-09").cast("date")), "append")
    h = spark.read.parquet(f"{root}/v1")
    assert sorted((r.id, r.name, r.valid_to is None) for r in h.collect()) == [(1, "a", False), (1, "b", True), (2, "c", True)]


def test_reports(spark):
    import json

    from driftledger.operators import report

    rows = [(1, 40, "F1001", "high", "proven", "m1", "a | b", "dismissed"), (2, 40, "F2001", "low", "likely", "m2", "c", None), (3, 7, "F3001", "medium", "likely", "m3", "d", None)]
    f = spark.createDataFrame(rows, "id int, run_id int, rule_id string, severity string, confidence string, model_name string, note string, disposition string")
    found = json.loads(report.json_report(f, 40, ("macros",)).first().report)
    assert [x["rule_id"] for x in found["findings"]] == ["F1001", "F2001"] and found["blind_spots"] == ["macros"]
    assert json.loads(report.json_report(f, 99, ()).first().report) == {"run": 99, "findings": [], "blind_spots": []}
    results = json.loads(report.sarif(f, 40).first().report)["runs"][0]["results"]
    assert [(r["level"], "suppressions" in r) for r in results] == [("error", True), ("note", False)]
    text = report.markdown(f.withColumn("rank", F.col("id")))
    assert text.count("\n") == 4 and "a \\| b" in text
    assert report.redacted(f, "s").columns == ["rule_id", "severity", "confidence", "model_name"] and "m1" not in {r.model_name for r in report.redacted(f, "s").collect()}
    with pytest.raises(ValueError, match="token"):
        report.drop_run_databases(spark, "x")


def test_changes_and_locations(spark):
    from driftledger.sources import changes as ch

    changed = spark.createDataFrame([("models/a.sql", "M"), ("macros/money.sql", "M"), ("README.md", "A"), ("models/schema.yml", "M")], "path string, status string")
    nodes = spark.createDataFrame([("a", "models/a.sql"), ("b", "models/b.sql"), ("c", "models/c.sql")], "name string, path string")
    macros = spark.createDataFrame([("money", "signed"), ("signed", "b"), ("other", "c")], "parent string, child string")
    assert sorted(tuple(r) for r in ch.changed_models(changed, nodes, macros).collect()) == [("a", "file"), ("b", "macro")]
    nodes = spark.createDataFrame([("s", True, False, False), ("m", True, True, False), ("n", True, True, False), ("o", False, False, True)], "name string, selected boolean, buildable boolean, exists boolean")
    edges = spark.createDataFrame([("s", "m"), ("o", "n")], "parent string, child string")
    assert {r.name: r.place for r in ch.locations(nodes, edges).collect()} == {"s": "blocked", "m": "blocked", "n": "built", "o": "read in place"}
