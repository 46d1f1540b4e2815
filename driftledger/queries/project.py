"""Queries on a project as a whole: change sets, keys from the best source, what a review left out, masked texts, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mask_invocation
from ..operators import grain
from ..operators.review import Store
from ..plans import impact
from ..sources import changes as ch
from ..sources.tables import table
from . import query
from .graph import M, _named, _walk, macro_edges
from .review_sql import store

# A project of models that is made from the parts: where each one's file and YAML stand, and its configuration then and now.
_NODES = "nodes as (select 'm' || p_partkey as name, 'models/' || (p_size % 4) || '/m' || p_partkey || '.sql' as path, 'models/' || (p_size % 4) || '/y' || (p_partkey % 9) || '.yml' as yaml_path, p_size % 7 as before, case when p_size % 11 = 0 then p_size % 5 else p_size % 7 end as after from part)"
_CHANGES = """changes as (select 'models/' || (p_size % 4) || '/m' || p_partkey || '.sql' as path from part where p_size = 50 union all select 'macros/x' || s_suppkey || '.sql' from supplier where s_suppkey % 40 = 3
union all select unnest(['models/2/y4.yml', 'dbt_project.yml', 'README.md', 'seeds/s.csv']) union all select 'analyses/a' || n_nationkey || '.SQL' from nation)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey").cast("string"), F.col("p_size")
    folder = F.concat(F.lit("models/"), (size % 4).cast("string"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), k).alias("name"), F.concat(folder, F.lit("/m"), k, F.lit(".sql")).alias("path"), F.concat(folder, F.lit("/y"), (F.col("p_partkey") % 9).cast("string"), F.lit(".yml")).alias("yaml_path"),
        (size % 7).alias("before"), F.when(size % 11 == 0, size % 5).otherwise(size % 7).alias("after"), "p_size",
    )


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    macros = table(spark, sf_dir, "supplier").where("s_suppkey % 40 = 3").select(F.concat(F.lit("macros/x"), F.col("s_suppkey").cast("string"), F.lit(".sql")))
    loose = table(spark, sf_dir, "nation").select(F.concat(F.lit("analyses/a"), F.col("n_nationkey").cast("string"), F.lit(".SQL")))
    others = spark.createDataFrame([("models/2/y4.yml",), ("dbt_project.yml",), ("README.md",), ("seeds/s.csv",)], "path string")
    return _nodes(spark, sf_dir).where("p_size = 50").select("path").union(macros).union(others).union(loose).withColumn("status", F.lit("M"))


@query("change_routing", f"""{_walk(M, "(select 'x' || s_suppkey as name from supplier where s_suppkey % 40 = 3)")}, {_NODES}, {_CHANGES},
r as (select name, 1 as why from nodes where path in (select path from changes) union all select name, 2 from cl where name[1] = 'm' union all select name, 3 from nodes where yaml_path in (select path from changes) union all select name, 4 from nodes where before is distinct from after)
select name, list_extract(['file', 'macro', 'yaml', 'project'], min(why)) as why from r group by name""")
def change_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model that a change set touches, and through what."""
    nodes = _nodes(spark, sf_dir)
    return ch.route_changes(_changes(spark, sf_dir), nodes, macro_edges(spark, sf_dir), nodes.select("name", "before", "after"))


@query("unanalysed_changes", f"with {_NODES}, {_CHANGES} select distinct path from changes where lower(path) like '%.sql' and path not in (select path from nodes) and path not in (select 'macros/x' || s_suppkey || '.sql' from supplier)")
def unanalysed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed SQL files that the project does not know."""
    macros = table(spark, sf_dir, "supplier").select(F.concat(F.lit("macros/x"), F.col("s_suppkey").cast("string"), F.lit(".sql")).alias("path"))
    return ch.not_analysed(_changes(spark, sf_dir), _nodes(spark, sf_dir), macros)


_CLAIMS = " union all ".join(f"select 'm' || p_partkey as name, '{k}' as key, {r} as grade from part where {c}" for r, k, c in ((1, "entry_id", "p_size % 10 = 0"), (2, "entry_id+period", "p_size % 10 in (0, 1)"), (3, "config_key", "p_size % 10 = 2"), (4, "tested_id", "p_size % 10 in (1, 3)"), (6, "guess_id", "p_size % 4 = 0")))
_PASSES = "select 'm' || (p_partkey - 1) as parent, 'm' || p_partkey as child from part where p_partkey % 12 > 0 and p_size % 3 > 0"


@query("grain_lattice", f"""with recursive claims as ({_CLAIMS}), sure as (select name, key, grade from (select *, row_number() over (partition by name order by grade, key) as rn from claims where grade <= 4) where rn = 1), passes as ({_PASSES}),
walk(name, key) as (select name, key from sure union select p.child, w.key from walk w join passes p on w.name = p.parent where p.child not in (select name from sure)),
r as (select name, key, grade from sure union all select name, min(key), 5 from walk where name not in (select name from sure) group by name)
select n.name, coalesce(r.key, g.key) as key, list_extract(['measured', 'structural', 'config', 'declared', 'propagated', 'heuristic', 'unknown'], coalesce(r.grade, g.grade, 7)) as source
from (select 'm' || p_partkey as name from part) n left join r on n.name = r.name left join (select * from claims where grade = 6) g on n.name = g.name""")
def grain_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of every model from its surest source, handed on through models that keep rows as they are."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    claims = (("measured", "entry_id", "p_size % 10 = 0"), ("structural", "entry_id+period", "p_size % 10 in (0, 1)"), ("config", "config_key", "p_size % 10 = 2"), ("declared", "tested_id", "p_size % 10 in (1, 3)"), ("heuristic", "guess_id", "p_size % 4 = 0"))
    one = F.explode(F.filter(F.array(*(F.when(F.expr(c), F.struct(F.lit(key).alias("key"), F.lit(s).alias("source"))) for s, key, c in claims)), lambda x: x.isNotNull()))
    known = part.select(_named("m", k).alias("name"), one.alias("c")).select("name", "c.*")
    passes = part.where("p_partkey % 12 > 0 and p_size % 3 > 0").select(_named("m", k - 1).alias("parent"), _named("m", k).alias("child"))
    return grain.resolve(part.select(_named("m", k).alias("name")), known, passes)


@query("relation_resolution", "select c_custkey, written, 'customer_' || lower(c_mktsegment) as node from (select c_custkey, c_mktsegment, case c_custkey % 3 when 0 then 'prod.\"Sales\".\"CUSTOMER_' || c_mktsegment || '\"' when 1 then 'customer_' || lower(c_mktsegment) else 'dev.other.' || c_mktsegment end as written from customer) where c_custkey % 3 < 2")
def relation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project's node that a written relation name means; names of no node drop out."""
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    rows = table(spark, sf_dir, "customer")
    written = F.when(k % 3 == 0, F.concat(F.lit('prod."Sales"."CUSTOMER_'), segment, F.lit('"'))).when(k % 3 == 1, F.concat(F.lit("customer_"), F.lower(segment))).otherwise(F.concat(F.lit("dev.other."), segment))
    nodes = rows.select(F.concat(F.lit("customer_"), F.lower(segment)).alias("node")).distinct()
    named = rows.select("c_custkey", written.alias("written")).withColumn("node", ch.relation_name(F.col("written")))
    return named.join(nodes, "node").select("c_custkey", "written", "node")


_SKIPPED = "skipped as (select run_id, rule_id from findings where confidence = 'possible' and id % 13 = 0)"


@query("review_completeness", store(f"""select * from (with {_SKIPPED} select id as run_id, 'grounding_degraded' as kind, cast(1 as bigint) as n from runs where status = 'failed' union all select id, 'execution_not_run', 1 from runs where id % 4 = 1 and not executed
union all select run_id, 'checks_skipped', count(*) from skipped group by run_id)"""))
def review_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way in which a review looked at less than it was asked to; a run that is not here is complete."""
    s = Store(spark, sf_dir)
    skipped = s.findings.where("confidence = 'possible' and id % 13 = 0").groupBy("run_id").agg(F.count(F.lit(1)).alias("skipped"))
    rows = s.runs.select(F.col("id").alias("run_id"), "status", "executed").join(skipped, "run_id", "left")
    ways = F.array(
        F.when(F.col("status") == "failed", F.struct(F.lit("grounding_degraded").alias("kind"), F.lit(1).cast("long").alias("n"))),
        F.when((F.col("run_id") % 4 == 1) & ~F.col("executed"), F.struct(F.lit("execution_not_run").alias("kind"), F.lit(1).cast("long").alias("n"))),
        F.when(F.col("skipped") > 0, F.struct(F.lit("checks_skipped").alias("kind"), F.col("skipped").alias("n"))),
    )
    return rows.select("run_id", F.explode(F.filter(ways, lambda x: x.isNotNull())).alias("w")).select("run_id", "w.*")


@query("visible_skips", store(f"""select * from (with {_NODES}, {_CHANGES} select 'X0003' as rule_id, path as subject from changes where lower(path) like '%.sql' and path not in (select path from nodes) and path not in (select 'macros/x' || s_suppkey || '.sql' from supplier)
union all select 'X0005', name from nodes where before = 1 and after = 1 and name[-1] = '0' union all select 'X0006', name from nodes where before = 2 and name[-1] = '1' union all select 'X0007', name from nodes where before = 3 and name[-1] = '2')"""))
def visible_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was not analysed, had no second pass, was not measured or not built, each as a row of its own."""
    nodes = _nodes(spark, sf_dir)
    ends = lambda d: F.col("name").endswith(d)
    why = F.when((F.col("before") == 1) & (F.col("after") == 1) & ends("0"), "X0005").when((F.col("before") == 2) & ends("1"), "X0006").when((F.col("before") == 3) & ends("2"), "X0007")
    own = nodes.select(why.alias("rule_id"), F.col("name").alias("subject")).where("rule_id is not null")
    return own.union(unanalysed_changes(spark, sf_dir).select(F.lit("X0003"), "path"))


@query("partial_compile", "select p_brand as project, count(*) as models, count(case when p_size % 8 = 0 then 1 end) as without_sql, case when count(case when p_size % 8 = 0 then 1 end) > 0 then count(case when p_size % 8 = 0 then 1 end) || ' of ' || count(*) || ' models have no compiled SQL' end as reason from part group by p_brand")
def partial_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each project's revision could not be compiled; null where all of it was."""
    bare, n = F.count_if(F.col("p_size") % 8 == 0), F.count(F.lit(1))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("project")).agg(n.alias("models"), bare.alias("without_sql"))
    said = F.concat(F.col("without_sql").cast("string"), F.lit(" of "), F.col("models").cast("string"), F.lit(" models have no compiled SQL"))
    return rows.withColumn("reason", F.when(F.col("without_sql") > 0, said))


@query("corpus_unscorable", """with o as (select p_partkey as id, p_size % 9 = 0 as degraded, p_size % 7 <> 0 as executed, case p_partkey % 11 when 0 then 'base' when 1 then 'head' when 2 then 'both' end as failed, p_size % 6 = 0 as meant_to_fail from part)
select * from (select id, case when degraded then 'grounding degraded' when not executed then null when failed in ('base', 'both') then 'base does not build' when failed = 'head' and not meant_to_fail then 'head does not build' when failed is null and meant_to_fail then 'meant to fail and built' end as reason from o) where reason is not null""")
def corpus_unscorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of the corpus that measured something other than the reviewer."""
    k, size = F.col("p_partkey"), F.col("p_size")
    failed = F.when(k % 11 == 0, "base").when(k % 11 == 1, "head").when(k % 11 == 2, "both")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), (size % 9 == 0).alias("degraded"), (size % 7 != 0).alias("executed"), failed.alias("failed"), (size % 6 == 0).alias("meant"))
    reason = (
        F.when(F.col("degraded"), "grounding degraded").when(~F.col("executed"), None).when(F.col("failed").isin("base", "both"), "base does not build")
        .when((F.col("failed") == "head") & ~F.col("meant"), "head does not build").when(F.col("failed").isNull() & F.col("meant"), "meant to fail and built")
    )
    return rows.select("id", reason.alias("reason")).where("reason is not null")


_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_TEXT = f"'select ''run-' || (event_id % 5) || ''' as run, ''' || {_STAMP} || ''' as at, ''2001-01-01 00:00:00'' as epoch'"


@query("invocation_masking", f"select event_id, replace(case when {_STAMP} between '2024-01-05 00:00:00' and '2024-01-20 00:00:00' then replace(text, '''' || {_STAMP} || '''', '''<started>''') else text end, '''run-3''', '''<invocation>''') as text from (select event_id, ts, {_TEXT} as text from events)")
def invocation_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled texts without what only says which run compiled them."""
    text = F.concat(F.lit("select 'run-"), (F.col("event_id") % 5).cast("string"), F.lit("' as run, '"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("' as at, '2001-01-01 00:00:00' as epoch"))
    return table(spark, sf_dir, "events").select("event_id", mask_invocation(text, "run-3", "2024-01-05 00:00:00", "2024-01-20 00:00:00").alias("text"))


_METRICS = ("sum(l_quantity)", "sum(l_extendedprice)", "sum(l_tax)")


@query("delta_maps", "select l_returnflag, column_name, cast(round(after - before, 2) as decimal(20,2)) as delta from (select l_returnflag, unnest(['l_quantity', 'l_extendedprice', 'l_tax']) as column_name, unnest([sum(l_quantity), sum(l_extendedprice), sum(l_tax)]) as after, unnest([sum(case when l_linestatus = 'O' then l_quantity else 0 end), sum(l_extendedprice), sum(case when l_linenumber > 1 then l_tax else 0 end)]) as before from lineitem group by l_returnflag) where abs(after - before) > 0.005")
def delta_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-column totals of two builds as maps; only columns that moved stay in the map of differences."""
    names, q = ("l_quantity", "l_extendedprice", "l_tax"), F.col
    kept = {"l_quantity": q("l_linestatus") == "O", "l_extendedprice": F.lit(True), "l_tax": q("l_linenumber") > 1}
    pair = lambda sums: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*sums))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(pair([F.sum(n) for n in names]).alias("after"), pair([F.sum(F.when(kept[n], q(n)).otherwise(0.0)) for n in names]).alias("before"))
    moved = F.map_filter(F.map_zip_with("before", "after", lambda k, b, a: a - b), lambda k, v: F.abs(v) > 0.005)
    rounded = F.transform_values(moved, lambda k, v: F.round(v, 2).cast("decimal(20,2)"))
    return rows.select("l_returnflag", F.explode(rounded).alias("column_name", "delta"))


#: Fixed cases: a model's text before and after, and the outputs that the change is confined to.
_OUTPUT_CASES = (
    ("rewritten", "select entry_id, amount_usd * 2 as a from entries", "select entry_id, amount_usd * 3 as a from entries", "a"),
    ("added", "select entry_id from entries", "select entry_id, period from entries", "period"),
    ("grouped", "select period, sum(amount_usd) s from entries group by period", "select period, max(amount_usd) s from entries group by period", "s"),
    ("reformatted", "select entry_id from entries", "SELECT  entry_id -- same\nFROM entries", ""),
    ("filtered", "select entry_id from entries", "select entry_id from entries where flag", None),
    ("star", "select * from entries", "select entry_id from entries", None),
    ("joined", "select e.entry_id from entries e", "select e.entry_id from entries e join rates r on e.currency_code = r.currency_code", None),
)


@query("changed_outputs", "select * from (values " + ", ".join(f"('{k}', {'null' if w is None else repr(w)})" for k, _, _, w in _OUTPUT_CASES) + ") t(name, columns)")
def changed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output columns that a change of text is confined to; null where it is not. Only plans are read."""
    found = [(k, impact.changed_outputs(spark, b, a)) for k, b, a, _ in _OUTPUT_CASES]
    return spark.createDataFrame([(k, None if x is None else "+".join(x)) for k, x in found], "name string, columns string")
