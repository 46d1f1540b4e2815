"""What a change set touches, and what of a project is built, read in place or blocked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import closure, settled


def file_class(path: Column) -> Column:
    """model, macro, seed, snapshot, config or other, by folder and suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    inside = lambda folder: path.rlike(rf"(^|/){folder}/")
    return (
        F.when((suffix == "sql") & inside("macros"), "macro").when((suffix == "sql") & inside("snapshots"), "snapshot").when((suffix == "sql") & inside("models"), "model")
        .when((suffix == "csv") & inside("seeds"), "seed").when(suffix.isin("yml", "yaml"), "config").otherwise("other")
    )


def changed_models(changes: DataFrame, nodes: DataFrame, macro_edges: DataFrame) -> DataFrame:
    """(name, why): models whose file changed, and those that call a changed macro, directly or through others.

    ``changes`` has (path, status), ``nodes`` (name, path), ``macro_edges`` (parent, child) from macros to callers.
    """
    changed = changes.select("path", file_class(F.col("path")).alias("kind"))
    direct = nodes.join(changed.where("kind in ('model', 'seed', 'snapshot')"), "path", "left_semi").select("name", F.lit("file").alias("why"))
    macros = changed.where("kind = 'macro'").select(F.regexp_extract("path", r"(\w+)\.sql$", 1).alias("name"))
    called = closure(macro_edges, macros).select(F.col("descendant").alias("name"), F.lit("macro").alias("why"))
    return direct.union(called.join(nodes.select("name"), "name", "left_semi").join(direct.select("name"), "name", "left_anti").distinct())


def route_changes(changes: DataFrame, nodes: DataFrame, macro_edges: DataFrame, configs: DataFrame) -> DataFrame:
    """(name, why) of every model that a change set touches: by its own file, a macro, its YAML, or the project's settings.

    ``changes`` has (path, status), ``nodes`` (name, path, yaml_path), ``configs`` (name, before, after) as structs or text.
    Each model has the first of these reasons; the project's settings touch those whose configuration differs.
    """
    changed = settled(changes.select("path", file_class(F.col("path")).alias("kind")))
    own = changed_models(changes, nodes.select("name", "path"), macro_edges)
    by_yaml = nodes.join(changed.where("kind = 'config'").select(F.col("path").alias("yaml_path")), "yaml_path", "left_semi").select("name", F.lit("yaml").alias("why"))
    project = changed.where(F.col("path").rlike(r"(^|/)dbt_project\.ya?ml$")).limit(1).select(F.lit(1).alias("one"))
    by_project = configs.where(~F.col("before").eqNullSafe(F.col("after"))).crossJoin(F.broadcast(project)).select("name", F.lit("project").alias("why"))  # one row at most
    order = F.array_position(F.array(*map(F.lit, ("file", "macro", "yaml", "project"))), F.col("why"))
    return own.union(by_yaml).union(by_project).groupBy("name").agg(F.min_by("why", order).alias("why"))


def not_analysed(changes: DataFrame, nodes: DataFrame, macro_paths: DataFrame) -> DataFrame:
    """(path): changed SQL files that no revision knows as a model, seed, snapshot or macro."""
    known = nodes.select("path").union(macro_paths.select("path"))
    return changes.where(F.lower("path").endswith(".sql")).select("path").distinct().join(known, "path", "left_anti")


def relation_name(text: Column) -> Column:
    """The last part of a written relation name, without quotes and in lower case."""
    return F.lower(F.replace(F.element_at(F.split(text, r"\."), -1), F.lit('"'), F.lit("")))


def locations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, place): built in this run, read in place, or blocked by something that cannot be built.

    ``nodes`` has (name, selected, buildable, exists). A selected node that cannot be built blocks all that read it,
    unless it exists already and can be read where it is.
    """
    blocking = nodes.where("not buildable and not exists").select("name")
    behind = closure(edges, blocking).select(F.col("descendant").alias("name"), F.lit(True).alias("behind")).distinct()
    rows = nodes.join(behind, "name", "left")
    place = F.when((~F.col("buildable") & ~F.col("exists")) | F.coalesce("behind", F.lit(False)), "blocked").when(F.col("selected") & F.col("buildable"), "built").otherwise("read in place")
    return rows.select("name", place.alias("place"))
