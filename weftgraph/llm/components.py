"""Connected components of links, as DataFrames: each node hooks to its smallest neighbour below it, trees are cut short
by pointer doubling, links are carried over to the roots, and so on until none is left between different roots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _roots(parents: DataFrame, table: Callable) -> DataFrame:
    """(node, parent), parent < node, to (node, comp): the root of each node that has a parent."""
    at = table(parents.select("node", F.col("parent").alias("comp")), "parents")
    while True:
        up = at.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        new = table(at.join(up, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp"), F.col("above").isNotNull().alias("moved")), "roots")
        moved = new.filter("moved").limit(1).count()
        at = new.select("node", "comp")
        if not moved:
            return at


def relabel(rows: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Node ids in the columns become their components' (a node without a label is its own)."""
    for c in columns:
        named = labels.select(F.col("node").alias(c), F.col("comp").alias("__to"))
        rows = rows.join(named, c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    return rows


def components(links: DataFrame, labels: DataFrame | None = None, table: Callable = written) -> DataFrame:
    """links: (a, b). Returns (node, comp) for the nodes whose component has a smaller node than themselves. ``labels``: the
    result for links seen earlier. ``table`` writes the steps down."""
    session = links.sparkSession
    if labels is None:
        labels = session.createDataFrame([], "node long, comp long")
    while True:
        ends = relabel(links, labels, ["a", "b"])
        links = table(ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        if not links.limit(1).count():
            return labels
        roots = _roots(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), table)
        labels = table(relabel(labels, roots, ["comp"]).unionByName(roots.join(labels, "node", "left_anti")), "labels")
