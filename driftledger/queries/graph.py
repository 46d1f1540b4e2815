"""Graph queries over a project of models and columns that is made from the parts and suppliers.

Models stand in twelve layers; a model reads two of the layer before it, some read one two layers up. Each has three
columns, which take a value of a parent's column or only refer to it. The SQL walks the same edges recursively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.tables import table
from . import query

E = """(select 'm' || (p_partkey - 1) as parent, 'm' || p_partkey as child from part where p_partkey % 12 > 0
union select 'm' || (p_partkey - 1 - 12 * ((p_partkey * 31 + p_size) % 5)), 'm' || p_partkey from part where p_partkey % 12 > 0
union select 'm' || (p_partkey - 2), 'm' || p_partkey from part where p_partkey % 12 > 1 and p_size % 5 = 0)"""
C = f"""(select parent as src_model, 'c' || ((j + p_size) % 3) as src_col, child as dst_model, 'c' || j as dst_col, case when (p_partkey + j) % 4 = 0 then 'reference' else 'value' end as kind
from {E} e join part on child = 'm' || p_partkey, (select unnest([0, 1, 2]) as j))"""
M = "(select 'x' || ((s_suppkey - 1) - (s_suppkey - 1) % 8 // 2) as parent, 'x' || s_suppkey as child from supplier where s_suppkey % 8 > 0 union select 'x' || (p_partkey % 64), 'm' || p_partkey from part where p_size % 10 = 0)"
X = "(select 'e' || s_suppkey as exposure, 'm' || (s_suppkey * 17) as model from supplier)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    parents = F.array_compact(F.array(
        F.when(k % 12 > 0, k - 1), F.when(k % 12 > 0, k - 1 - 12 * ((k * 31 + F.col("p_size")) % 5)), F.when((k % 12 > 1) & (F.col("p_size") % 5 == 0), k - 2)
    ))
    return part.select(F.explode(F.array_distinct(parents)).alias("p"), _named("m", k).alias("child")).select(_named("m", F.col("p")).alias("parent"), "child")


def _named(letter: str, number: Column) -> Column:
    return F.concat(F.lit(letter), number.cast("string"))


def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(_named("m", F.col("p_partkey")).alias("child"), "p_partkey", "p_size")
    rows = edges(spark, sf_dir).join(part, "child").withColumn("j", F.explode(F.array(*map(F.lit, range(3)))))
    kind = F.when((F.col("p_partkey") + F.col("j")) % 4 == 0, "reference").otherwise("value")
    return rows.select(F.col("parent").alias("src_model"), _named("c", (F.col("j") + F.col("p_size")) % 3).alias("src_col"), F.col("child").alias("dst_model"), _named("c", F.col("j")).alias("dst_col"), kind.alias("kind"))


def macro_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("s_suppkey") - 1, F.col("p_partkey")
    own = table(spark, sf_dir, "supplier").where("s_suppkey % 8 > 0").select(_named("x", s - F.floor((s % 8) / 2)).alias("parent"), _named("x", F.col("s_suppkey")).alias("child"))
    return own.union(table(spark, sf_dir, "part").where("p_size % 10 = 0").select(_named("x", k % 64), _named("m", k)))


def models(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    """(name) of the models whose part meets the condition."""
    return table(spark, sf_dir, "part").where(condition).select(_named("m", F.col("p_partkey")).alias("name"))


def _models(condition: str) -> str:
    return f"(select 'm' || p_partkey as name from part where {condition})"


def _walk(edge_sql: str, starts: str | None = None, back: bool = False) -> str:
    """cl(origin, name, depth) by recursion over distinct rows."""
    a, b = ("child", "parent") if back else ("parent", "child")
    first = f"select {a} as origin, {b} as name, 1 as depth from e" + (f" where {a} in (select name from {starts})" if starts else "")
    return f"with recursive e as (select * from {edge_sql}), walk(origin, name, depth) as ({first} union select w.origin, e.{b}, w.depth + 1 from walk w join e on w.name = e.{a}), cl as (select origin, name, min(depth) as depth from walk group by all)"


V = f"(select src_model || '.' || src_col as parent, dst_model || '.' || dst_col as child from {C} where kind = 'value')"
_CC = "cc as (select split_part(origin, '.', 1) as src_model, split_part(origin, '.', 2) as src_col, split_part(name, '.', 1) as dst_model, split_part(name, '.', 2) as dst_col, depth from cl)"
CHANGED, GOVERNED, DEPENDENT, BLOCKED, STAMPED, MOVED = "p_size = 50", "p_size = 1", "p_size = 7", "p_size = 13", "p_size in (3, 4)", "p_size % 6 = 0"


@query("graph_downstream", f"{_walk(E, _models(CHANGED))} select * from cl")
def graph_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is behind each changed model."""
    return graph.reach(edges(spark, sf_dir), models(spark, sf_dir, CHANGED))


@query("graph_ancestors", f"{_walk(E, _models(GOVERNED), True)} select * from cl")
def graph_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each governed model is made from."""
    return graph.reach(graph.reversed_edges(edges(spark, sf_dir)), models(spark, sf_dir, GOVERNED))


@query("graph_macro_closure", f"{_walk(M)} select origin as macro, name as caller, depth from cl where origin[1] = 'x' and name[1] = 'm'")
def graph_macro_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that a macro reaches, directly or through other macros."""
    found = graph.reach(macro_edges(spark, sf_dir)).where("origin like 'x%' and name like 'm%'")
    return found.select(F.col("origin").alias("macro"), F.col("name").alias("caller"), "depth")


@query("graph_taint", f"{_walk(E, _models(DEPENDENT))} select name as model, max(direct) = 1 as direct from (select name, 1 as direct from {_models(DEPENDENT)} union all select name, 0 from cl) group by name")
def graph_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models whose text is built from query results, directly or through what they read."""
    direct = models(spark, sf_dir, DEPENDENT)
    reached = graph.reach(edges(spark, sf_dir), direct).select("name", F.lit(False).alias("direct"))
    return direct.withColumn("direct", F.lit(True)).union(reached).groupBy(F.col("name").alias("model")).agg(F.bool_or("direct").alias("direct"))


@query("graph_topo_level", f"with recursive e as (select * from {E}), walk(name, level) as (select parent, 0 from e where parent not in (select child from e) union select e.child, w.level + 1 from walk w join e on w.name = e.parent) select name, max(level) as level from walk group by name")
def graph_topo_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(edges(spark, sf_dir))


@query("graph_blocked_nodes", f"{_walk(E, _models(BLOCKED))} select name, max(root) = 1 as is_root from (select name, 1 as root from {_models(BLOCKED)} union all select name, 0 from cl) group by name")
def graph_blocked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cannot be built because something that it reads cannot."""
    roots = models(spark, sf_dir, BLOCKED)
    reached = graph.reach(edges(spark, sf_dir), roots).select("name", F.lit(False).alias("is_root"))
    return roots.withColumn("is_root", F.lit(True)).union(reached).groupBy("name").agg(F.bool_or("is_root").alias("is_root"))


@query("graph_exposure_reach", f"{_walk(E, f'(select model as name from {X})', True)} select exposure, count(cl.name) as affected_by, count(case when cl.name in (select name from {_models(CHANGED)}) then 1 end) > 0 as reached_by_change from {X} x left join cl on x.model = cl.origin group by exposure")
def graph_exposure_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many models stand behind each exposure, and whether a changed one does."""
    k = F.col("s_suppkey")
    exposures = table(spark, sf_dir, "supplier").select(_named("e", k).alias("exposure"), _named("m", k * 17).alias("origin"))
    above = graph.reach(graph.reversed_edges(edges(spark, sf_dir)), exposures.select(F.col("origin").alias("name")))
    above = above.join(models(spark, sf_dir, CHANGED).withColumn("changed", F.lit(True)), "name", "left")
    return exposures.join(above, "origin", "left").groupBy("exposure").agg(F.count("name").alias("affected_by"), F.coalesce(F.bool_or("changed"), F.lit(False)).alias("reached_by_change"))


def _roots(condition: str) -> str:
    return f"(select name || '.c0' as name from {_models(condition)})"


def _columns(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return models(spark, sf_dir, condition).select(F.col("name").alias("model"), F.lit("c0").alias("col"))


@query("graph_volatile_columns", f"{_walk(V, _roots(STAMPED))}, {_CC} select dst_model as model, dst_col as col from cc union select name, 'c0' from {_models(STAMPED)}")
def graph_volatile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that a volatile one flows into."""
    roots = _columns(spark, sf_dir, STAMPED)
    return graph.column_reach(column_edges(spark, sf_dir), roots).select(F.col("dst_model").alias("model"), F.col("dst_col").alias("col")).union(roots).distinct()


@query("lineage_consumers", f"{_walk(V, _roots(CHANGED))}, {_CC} select * from cc")
def lineage_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first column of each changed model ends up."""
    return graph.column_reach(column_edges(spark, sf_dir), _columns(spark, sf_dir, CHANGED))


@query("lineage_sources", f"{_walk(V, _roots(GOVERNED), True)}, {_CC} select dst_model as src_model, dst_col as src_col, src_model as dst_model, src_col as dst_col, depth from cc")
def lineage_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first column of each governed model is made of."""
    back = column_edges(spark, sf_dir).select(F.col("dst_model").alias("src_model"), F.col("dst_col").alias("src_col"), F.col("src_model").alias("dst_model"), F.col("src_col").alias("dst_col"), "kind")
    found = graph.column_reach(back, _columns(spark, sf_dir, GOVERNED))
    return found.select(F.col("dst_model").alias("src_model"), F.col("dst_col").alias("src_col"), F.col("src_model").alias("dst_model"), F.col("src_col").alias("dst_col"), "depth")


@query("lineage_consumer_models", f"{_walk(V, _roots(CHANGED))}, {_CC} select distinct src_model as origin, dst_model as model from cc union select src_model, dst_model from {C} where kind = 'reference' and src_col = 'c0' and src_model in (select name from {_models(CHANGED)})")
def lineage_consumer_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that a changed column reaches by value, and those that refer to it."""
    direct, roots = column_edges(spark, sf_dir), _columns(spark, sf_dir, CHANGED)
    by_value = graph.column_reach(direct, roots).select(F.col("src_model").alias("origin"), F.col("dst_model").alias("model"))
    own = direct.where("kind = 'reference' and src_col = 'c0'").join(roots.select(F.col("model").alias("src_model")), "src_model", "left_semi")
    return by_value.union(own.select("src_model", "dst_model")).distinct()


@query("lineage_referencing_only", f"{_walk(V)}, {_CC} select distinct src_model, src_col, dst_model from {C} ce where kind = 'reference' and not exists (select 1 from cc where cc.src_model = ce.src_model and cc.src_col = ce.src_col and cc.dst_model = ce.dst_model)")
def lineage_referencing_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that a model refers to without any of its columns taking their value."""
    direct, keys = column_edges(spark, sf_dir), ["src_model", "src_col", "dst_model"]
    return direct.where("kind = 'reference'").select(*keys).distinct().join(graph.column_reach(direct).select(*keys), keys, "left_anti")


@query("impact_narrow", f"{_walk(E, _models(CHANGED))}, r as ({_walk(V, _roots(CHANGED))}, {_CC} select distinct src_model, dst_model from cc), t as (select distinct dst_model from {C} where kind = 'value') select cl.origin, cl.name as model, r.dst_model is not null as reached, t.dst_model is not null as traced from cl left join r on cl.origin = r.src_model and cl.name = r.dst_model left join t on cl.name = t.dst_model")
def impact_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which models behind a change its column reaches; those without traced columns cannot be ruled out."""
    columns = column_edges(spark, sf_dir)
    behind = graph.reach(edges(spark, sf_dir), models(spark, sf_dir, CHANGED)).select("origin", F.col("name").alias("model"))
    reached = graph.column_reach(columns, _columns(spark, sf_dir, CHANGED)).select(F.col("src_model").alias("origin"), F.col("dst_model").alias("model"), F.lit(True).alias("reached")).distinct()
    traced = columns.where("kind = 'value'").select(F.col("dst_model").alias("model"), F.lit(True).alias("traced")).distinct()
    rows = behind.join(reached, ["origin", "model"], "left").join(traced, "model", "left")
    return rows.select("origin", "model", F.coalesce("reached", F.lit(False)).alias("reached"), F.coalesce("traced", F.lit(False)).alias("traced"))


@query("attribute_to_root", f"{_walk(E, _models(MOVED))}, mv as (select name as model from {_models(MOVED)}), roots as (select model from mv where model not in (select name from cl)) select mv.model, coalesce(min(case when cl.origin in (select model from roots) then cl.origin end), mv.model) as origin from mv left join cl on cl.name = mv.model group by mv.model")
def attribute_to_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moved model upstream of each moved one that nothing moved above, the first by name."""
    moved = models(spark, sf_dir, MOVED)
    pairs = graph.reach(edges(spark, sf_dir), moved)
    roots = moved.join(pairs.select("name"), "name", "left_anti").select(F.col("name").alias("origin"))
    origin = pairs.join(roots, "origin", "left_semi").groupBy("name").agg(F.min("origin").alias("origin"))
    return moved.join(origin, "name", "left").select(F.col("name").alias("model"), F.coalesce("origin", "name").alias("origin"))


_WRITTEN = "(select 'm' || p_partkey as model, 'm' || (p_partkey - 1 - 12 * (p_size % 3)) as reads from part where p_partkey % 12 > 0)"


@query("hidden_reads", f"select model, reads from {_WRITTEN} w where not exists (select 1 from {E} e where e.parent = w.reads and e.child = w.model)")
def hidden_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that a model's text reads by name without a declared edge."""
    k = F.col("p_partkey")
    written = table(spark, sf_dir, "part").where("p_partkey % 12 > 0").select(_named("m", k).alias("model"), _named("m", k - 1 - 12 * (F.col("p_size") % 3)).alias("reads"))
    return written.join(edges(spark, sf_dir).select(F.col("parent").alias("reads"), F.col("child").alias("model")), ["model", "reads"], "left_anti")
