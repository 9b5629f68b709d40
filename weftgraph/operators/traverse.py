"""Cycles and paths over the file-level projection, which is small beside the item-level edges.

Reachability runs as frontier joins and labels that spread along edges, each step written down by checkpoint(), with a row
per file at most. Only the listing of cycles by depth-first search is order-dependent: it runs in a task per weakly
connected part of the call edges that lead to a cycle, and a part is all that such a task holds."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..model import CodeGraph
from ..sources.shared import checkpointed


def call_edges(graph: CodeGraph) -> DataFrame:
    """Distinct (u, v), calls between different files."""
    return graph.file_edges().filter("rel_type = 'Calls'").select(F.col("src_path").alias("u"), F.col("dst_path").alias("v")).distinct()


def _trimmed(edges: DataFrame, sources: bool) -> DataFrame:
    """Edges left when files without a way out (and, if ``sources``, without a way in) are taken away again and again."""
    edges = checkpointed(edges)
    n = edges.count()
    while True:
        left = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if sources:
            left = left.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        edges = checkpointed(left.select("u", "v"))
        m = edges.count()
        if m in (n, 0):
            return edges
        n = m


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges between files with a way in and a way out: all that lie on a cycle do stay."""
    return _trimmed(edges, True)


def leading_to_cycles(edges: DataFrame) -> DataFrame:
    """Edges from which a cycle can be reached. What leads nowhere has no say in a depth-first search's cycles; what leads
    in has, as it decides where a cycle is entered."""
    return _trimmed(edges, False)


def _spread(edges: DataFrame) -> DataFrame:
    """(node, label): the greatest node from which each node can be reached, itself included."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = checkpointed(nodes.withColumn("label", F.col("node")))
    while True:
        come = edges.join(labels.select(F.col("node").alias("u"), F.col("label").alias("new")), "u").groupBy(F.col("v").alias("node")).agg(F.max("new").alias("new"))
        labels = labels.join(come, "node", "left").select("node", F.greatest("label", F.coalesce("new", "label")).alias("label"), (F.col("new") > F.col("label")).alias("moved"))
        labels = checkpointed(labels)
        if not labels.filter("moved").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def weak_parts(edges: DataFrame) -> DataFrame:
    """(node, label): a label per weakly connected part."""
    return _spread(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))


def strong_parts(edges: DataFrame) -> DataFrame:
    """(node, label): a label per set of two or more nodes that all reach one another. The greatest node to reach a node is
    its colour; the nodes that reach the one of their colour within the colour are a part. Parts are taken away and the
    rest coloured anew until nothing is left."""
    edges, done = on_cycles(edges), []
    while edges.limit(1).count():
        colour = _spread(edges)
        same = edges.join(colour.select(F.col("node").alias("u"), F.col("label").alias("cu")), "u").join(colour.select(F.col("node").alias("v"), F.col("label").alias("cv")), "v")
        same = checkpointed(same.filter("cu = cv").select("u", "v"))
        levels = [checkpointed(colour.filter("node = label"))]
        while levels[-1].limit(1).count():
            back = same.join(levels[-1].select(F.col("node").alias("v"), "label"), "v").select(F.col("u").alias("node"), "label").distinct()
            for level in levels:
                back = back.join(level.select("node"), "node", "left_anti")
            levels.append(checkpointed(back))
            if len(levels) > 16:
                levels = [checkpointed(reduce(DataFrame.unionByName, levels[:-1])), levels[-1]]
        found = checkpointed(reduce(DataFrame.unionByName, levels))
        done.append(found.join(found.groupBy("label").count().filter("count > 1").select("label"), "label", "left_semi"))
        gone = found.select("node")
        edges = on_cycles(edges.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"))
    return reduce(DataFrame.unionByName, done) if done else edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _depth_first(edges: pd.DataFrame) -> pd.DataFrame:
    key = lambda p: p.split("/")
    near: dict[str, list[str]] = {}
    for u, v in zip(edges["u"], edges["v"]):
        near.setdefault(u, []).append(v)
        near.setdefault(v, [])
    for u in near:
        near[u].sort(key=key)
    found, seen, on_stack = [], set(), {}
    for root in sorted(near, key=key):
        if root in seen:
            continue
        seen.add(root)
        stack, trail = [iter(near[root])], [root]
        on_stack[root] = 0
        while stack:
            v = next(stack[-1], None)
            if v is None:
                stack.pop()
                del on_stack[trail.pop()]
            elif v in on_stack:
                found.append((trail[0], trail[on_stack[v] :]))
            elif v not in seen:
                seen.add(v)
                on_stack[v] = len(trail)
                trail.append(v)
                stack.append(iter(near[v]))
    rows = [(r, i, " -> ".join(c), len(c)) for i, (r, c) in enumerate(found)]
    return pd.DataFrame(rows, columns=["root", "turn", "files", "length"]).astype({"turn": "int64", "length": "int64"})


def cycles(graph: CodeGraph) -> DataFrame:
    """One cycle per back edge of a depth-first search that takes files in path order: cycle (its number), files, length. No
    search leaves the weakly connected part it began in, so each part is searched by itself; all cycles are then put in
    the order of the files where their searches began, and numbered part by part of the sorted rows."""
    edges = leading_to_cycles(call_edges(graph))
    parts = edges.join(weak_parts(edges).withColumnRenamed("node", "u"), "u")
    found = parts.groupBy("label").applyInPandas(_depth_first, "root string, turn long, files string, length long")
    numbered = checkpointed(found).orderBy(paths.parts("root"), "turn").select("files", "length").rdd.zipWithIndex()
    return numbered.map(lambda r: (r[1], r[0][0], r[0][1])).toDF("cycle long, files string, length long")


def cycle_members(graph: CodeGraph) -> DataFrame:
    """Files that reach themselves by calls."""
    return strong_parts(call_edges(graph)).select(F.col("node").alias("path"))


def _levels(graph: CodeGraph, source: str, target: str | None) -> list[DataFrame]:
    """(path, parent, step) by level, each a table of its own; files seen at 16 levels are gathered in one."""
    edges = checkpointed(graph.file_edges().select(F.col("src_path").alias("u"), F.col("dst_path").alias("v")).distinct())
    start = graph.items.filter(F.col("path") == source).select("path", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("step")).distinct()
    levels, seen = [checkpointed(start)], []
    while True:
        seen.append(levels[-1].select("path"))
        if len(seen) > 16:
            seen = [checkpointed(reduce(DataFrame.unionByName, seen))]
        best = F.min(F.struct(paths.parts("u").alias("k"), F.col("u").alias("u")))
        new = edges.join(levels[-1].select(F.col("path").alias("u")), "u").groupBy(F.col("v").alias("path")).agg(best["u"].alias("parent"))
        for s in seen:
            new = new.join(s, "path", "left_anti")
        levels.append(checkpointed(new.select("path", "parent", F.lit(len(levels)).cast("long").alias("step"))))
        found = levels[-1].agg(F.count(F.lit(1)), F.sum((F.col("path") == F.lit(target)).cast("int"))).first()
        if not found[0]:
            return levels[:-1]
        if found[1]:
            return levels


def distances(graph: CodeGraph, source: str, target: str | None = None) -> DataFrame:
    """(path, parent, step) of the files that can be reached from source along edges of any type, level by level; the
    search ends at the level of target. Of equal predecessors the smallest in path order is the parent."""
    return reduce(DataFrame.unionByName, _levels(graph, source, target))


def shortest_path(graph: CodeGraph, source: str, target: str) -> DataFrame:
    """(step, path) of a shortest directed path over all edge types; of equal ones, each file follows the smallest
    predecessor in path order. Empty without one. The way back is a join per level, and one row of each."""
    levels = _levels(graph, source, None if source == target else target)
    if source == target:
        return levels[0].select("step", "path")
    at = levels[-1].filter(F.col("path") == target)
    trail = [at]
    for n, level in enumerate(reversed(levels[:-1])):
        at = level.join(F.broadcast(at.select(F.col("parent").alias("path"))), "path", "left_semi").select("path", "parent", "step")
        at = checkpointed(at) if n % 8 == 7 else at
        trail.append(at)
    return reduce(DataFrame.unionByName, trail).select("step", "path").orderBy("step")
