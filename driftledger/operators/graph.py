"""Graphs of models and of columns: what is reached from where, levels, and what follows from them.

A graph of counted size, as a project's nearly always is, goes to the workers whole, and each walks from its share of the
starts. Beyond that, walks go on one step of all origins at a time, each step written to the checkpoint folder. Either way
they end when nothing new is found, and keep distinct pairs, not paths: layered graphs do not multiply, cycles end.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """The frame, computed and written to the folder of spark.checkpoint.dir; a temporary one only on a single machine."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="driftledger-"))
    return df.checkpoint()


#: Edges that are taken for few enough to be held by the driver and by every worker, about 10 MB.
FEW_EDGES = 200_000


def _held(edges: DataFrame, few: int) -> dict[str, list[str]] | None:
    """Children of each parent, if there are few enough edges."""
    rows = edges.limit(few + 1).collect()
    if len(rows) > few:
        return None
    out: dict[str, list[str]] = defaultdict(list)
    for r in rows:
        out[r.parent].append(r.child)
    return dict(out)


def _walks(children: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin in batch.column(0).to_pylist():
                depth, step, n = {}, [origin], 0
                while step:
                    n += 1
                    step = [c for c in dict.fromkeys(c for x in step for c in children.get(x, ())) if c not in depth]
                    depth.update(dict.fromkeys(step, n))
                if depth:
                    yield pa.RecordBatch.from_arrays([pa.array([origin] * len(depth)), pa.array(list(depth)), pa.array(list(depth.values()), pa.int32())], ["origin", "name", "depth"])

    return run


def reach(edges: DataFrame, starts: DataFrame | None = None, few: int = FEW_EDGES) -> DataFrame:
    """(origin, name, depth): what each start (name) leads to by edges (parent, child), with the shortest distance.

    Without starts, from every node. A node on a cycle reaches itself.
    """
    edges = edges.select("parent", "child").distinct()
    if (children := _held(edges, few)) is not None:
        names = (edges.select(F.col("parent").alias("name")) if starts is None else starts.select("name")).where("name is not null").distinct()
        return names.mapInArrow(_walks(children), "origin string, name string, depth int")
    edges = settled(edges)
    first = edges if starts is None else edges.join(starts.select(F.col("name").alias("parent")).distinct(), "parent", "left_semi")
    step = found = settled(first.select(F.col("parent").alias("origin"), F.col("child").alias("name"), F.lit(1).alias("depth")))
    while not step.isEmpty():
        further = step.join(edges, F.col("name") == F.col("parent")).select("origin", F.col("child").alias("name"), (F.col("depth") + 1).alias("depth")).distinct()
        step = settled(further.join(found.select("origin", "name"), ["origin", "name"], "left_anti"))
        found = found.unionByName(step)
    return found


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))


def closure(edges: DataFrame, starts: DataFrame | None = None, few: int = FEW_EDGES) -> DataFrame:
    """(ancestor, descendant, depth): every reachable pair, or those below the starts."""
    return reach(edges, starts, few).select(F.col("origin").alias("ancestor"), F.col("name").alias("descendant"), "depth")


def _levels(children: dict[str, list[str]]) -> dict[str, int | None]:
    waiting: dict[str, int] = dict.fromkeys(children, 0)
    for c in (c for own in children.values() for c in own):
        waiting[c] = waiting.get(c, 0) + 1
    out: dict[str, int | None] = dict.fromkeys(waiting)
    ready, level = [x for x, n in waiting.items() if not n], 0
    while ready:
        out.update(dict.fromkeys(ready, level))
        below = []
        for c in (c for x in ready for c in children.get(x, ())):
            waiting[c] -= 1
            if not waiting[c]:
                below.append(c)
        ready, level = below, level + 1
    return out


def levels(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(name, level): the longest chain that leads to a node, zero for roots; null on and behind a cycle, which has none."""
    left = edges.select("parent", "child").distinct()
    if (children := _held(left, few)) is not None:
        return edges.sparkSession.createDataFrame(list(_levels(children).items()), "name string, level int")
    left = settled(left)
    waiting = settled(left.select(F.col("parent").alias("name")).union(left.select("child")).distinct())
    placed, level = None, 0
    while True:
        ready = settled(waiting.join(left.select(F.col("child").alias("name")).distinct(), "name", "left_anti"))
        if ready.isEmpty():
            rest = waiting.select("name", F.lit(None).cast("int").alias("level"))
            return rest if placed is None else placed.unionByName(rest)
        one = ready.select("name", F.lit(level).alias("level"))
        placed = one if placed is None else placed.unionByName(one)
        waiting = settled(waiting.join(ready, "name", "left_anti"))
        left = settled(left.join(ready.select(F.col("name").alias("parent")), "parent", "left_anti"))
        level += 1


def column_node(model: str, column: str):
    return F.concat_ws(".", model, column)


def value_edges(edges: DataFrame) -> DataFrame:
    """(parent, child) between columns as model.column, of edges (src_model, src_col, dst_model, dst_col, kind) that pass a value on."""
    return edges.where("kind = 'value'").select(column_node("src_model", "src_col").alias("parent"), column_node("dst_model", "dst_col").alias("child"))


def column_reach(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(src_model, src_col, dst_model, dst_col, depth) over value edges, from the starts (model, col) or from every column."""
    pairs = reach(value_edges(edges), starts if starts is None else starts.select(column_node("model", "col").alias("name")))
    split = lambda c, n: F.split_part(c, F.lit("."), F.lit(n))
    return pairs.select(split("origin", 1).alias("src_model"), split("origin", 2).alias("src_col"), split("name", 1).alias("dst_model"), split("name", 2).alias("dst_col"), "depth")
