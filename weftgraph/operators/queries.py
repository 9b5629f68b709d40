"""The graph queries. Each takes a CodeGraph and returns a DataFrame; order is a column (rank) where it matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..model import CodeGraph
from .relate import module_parents


def page(df: DataFrame, order: list, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows offset to offset + limit in the given order: a top-k plan where there is a limit."""
    df = df.orderBy(*order).offset(offset) if offset else df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def _owned(graph: CodeGraph, ids: DataFrame) -> DataFrame:
    """item_owner() of the given ids (distinct item_id) only."""
    return graph.item_owner(graph.items.join(ids, "item_id", "left_semi"))


def connected_files(graph: CodeGraph, file: str) -> DataFrame:
    """Other files with an edge to or from the file. Starts from the file's own items: of the edges only theirs are kept, in
    one pass, and owners are sought for the other ends of these only."""
    here = graph.items.filter(F.col("path") == file).select("item_id").distinct()
    own = _owned(graph, here).filter(F.col("path") == file).select(F.col("item_id").alias("near"))
    ends = F.explode(F.array(F.struct(F.col("from_item").alias("near"), F.col("to_item").alias("item_id")), F.struct(F.col("to_item").alias("near"), F.col("from_item").alias("item_id"))))
    far = graph.relationships.select(ends.alias("e")).select("e.near", "e.item_id").join(own, "near", "left_semi").select("item_id").distinct()
    return _owned(graph, far).filter(F.col("path") != file).select("path").distinct().orderBy(paths.parts("path"))


def function_usage(graph: CodeGraph, name: str, direction: str = "callers") -> DataFrame:
    """Files with an edge of any type to (callers) or from (callees) a function of that name; its own file counts."""
    near, far = ("to_item", "from_item") if direction == "callers" else ("from_item", "to_item")
    ids = graph.items.filter((F.col("kind") == "Function") & (F.col("name") == name)).select(F.col("item_id").alias(near)).distinct()
    ends = graph.relationships.join(ids, near, "left_semi").select(F.col(far).alias("item_id")).distinct()
    return _owned(graph, ends).select("path").distinct().orderBy(paths.parts("path"))


def degrees(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, indegree, outdegree) of every node, in one pass over the edges; ``n`` counts multi-edges."""
    zero = F.lit(0).cast("bigint")
    ends = F.explode(F.array(F.struct(F.col("src").alias("key"), F.col("n").alias("o"), zero.alias("i")), F.struct(F.col("dst").alias("key"), zero.alias("o"), F.col("n").alias("i"))))
    sums = edges.select(ends.alias("e")).groupBy(F.col("e.key").alias(key)).agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    return nodes.join(sums, key, "left").select(key, F.coalesce("i", F.lit(0)).cast("bigint").alias("indegree"), F.coalesce("o", F.lit(0)).cast("bigint").alias("outdegree"))


def _ranked(df: DataFrame, key: str, metric: str, top: int | None) -> DataFrame:
    value: Column = {"in": F.col("indegree"), "out": F.col("outdegree"), "total": F.col("indegree") + F.col("outdegree")}[metric]
    order = [value.desc(), paths.parts(key)]
    return df.orderBy(*order) if top is None else df.orderBy(*order).limit(top)


def hubs(graph: CodeGraph, metric: str = "total", top: int | None = 10) -> DataFrame:
    """Files by degree over multi-edges, without loops; files without edges count."""
    edges = graph.file_edges().select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"), "n")
    return _ranked(degrees(edges, graph.items.select("path").distinct(), "path"), "path", metric, top)


def module_centrality(graph: CodeGraph, metric: str = "total", top: int | None = 10) -> DataFrame:
    """The same for the files' folders."""
    edges = graph.file_edges().groupBy(paths.dirname("src_path").alias("src"), paths.dirname("dst_path").alias("dst")).agg(F.sum("n").alias("n")).filter("src <> dst")
    return _ranked(degrees(edges, graph.items.select(paths.dirname("path").alias("module")).distinct(), "module"), "module", metric, top)


def module_parent(graph: CodeGraph, file: str) -> DataFrame:
    """The file whose module holds that of the file: path, one row or none."""
    return module_parents(graph.files).filter(F.col("path") == file).select(F.col("parent").alias("path"))


def module_children(graph: CodeGraph, file: str) -> DataFrame:
    """The files whose modules that of the file holds."""
    return module_parents(graph.files).filter(F.col("parent") == file).select("path").orderBy(paths.parts("path"))


def trait_impls(graph: CodeGraph, trait: str) -> DataFrame:
    found = graph.items.filter((F.col("kind") == "Impl") & (F.col("attrs.trait_name") == trait))
    return found.select("path", F.col("attrs.type_name").alias("type")).orderBy(paths.parts("path"), "type")


def visibility_label(scoped: bool) -> Column:
    """scoped: pub(in X) with its X, else pub(in)."""
    inside = F.concat(F.lit("pub(in "), F.coalesce("vis_scope", F.lit("")), F.lit(")")) if scoped else F.lit("pub(in)")
    v = F.col("visibility")
    return F.when(v == "Public", "public").when(v == "PubCrate", "pub(crate)").when(v == "PubSuper", "pub(super)").when(v == "PubIn", inside).otherwise("private")


def unreferenced_items(graph: CodeGraph, include_public: bool = False, exclude: str | None = None) -> DataFrame:
    """Items that no Uses or Calls edge points to."""
    used = graph.relationships.filter(F.col("rel_type").isin("Uses", "Calls")).select(F.col("to_item").alias("item_id")).distinct()
    found = graph.items.filter("ordinal > 0")
    found = found if include_public else found.filter("visibility <> 'Public'")
    found = found if exclude is None else found.filter(~F.rlike("path", F.lit(exclude)))
    return found.join(used, "item_id", "left_anti").orderBy(paths.parts("path"), "ordinal").select("path", F.col("item_id").alias("id"), "name", "kind", visibility_label(False).alias("visibility"))


def item_info(graph: CodeGraph, item_id: str) -> DataFrame:
    """The item of that id (that of its owner), with kind, visibility and location."""
    owner = graph.item_owner().filter(F.col("item_id") == item_id)
    found = graph.items.filter(F.col("item_id") == item_id).join(owner, ["item_id", "path"])
    return found.orderBy("ordinal").limit(1).select("item_id", "path", "kind", "name", visibility_label(True).alias("visibility"), "line_start", "line_end")


def item_code(graph: CodeGraph, item_id: str) -> DataFrame:
    """The item's lines of its file."""
    lines = F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")
    return item_info(graph, item_id).join(graph.files.select("path", "content"), "path").select("item_id", F.array_join(F.slice(lines, F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int")), "\n").alias("code"))


def relation_label() -> Column:
    return F.concat(F.col("rel_type"), F.lit(":"), F.col("rel_detail"))


def item_relations(graph: CodeGraph, item_id: str, direction: str) -> DataFrame:
    """Edges into (inbound) or out of (outbound) an item whose other end is a known item."""
    near, far = ("to_item", "from_item") if direction == "inbound" else ("from_item", "to_item")
    edges = graph.relationships.filter(F.col(near) == item_id).select(F.col(far).alias("item_id"), relation_label().alias("relation"), "strength", "context")
    ends = graph.items.join(edges.select("item_id").distinct(), "item_id", "left_semi")
    names = ends.groupBy("item_id").agg(F.max(F.struct(paths.parts("path").alias("key"), F.col("ordinal").alias("ordinal"), F.col("path").alias("path"), F.col("name").alias("name"))).alias("m"))
    return edges.join(names, "item_id").select("item_id", F.col("m.name").alias("name"), F.col("m.path").alias("path"), "relation", "strength", "context")


#: An edge of an item, as item_details() lists it.
EDGE = "struct<id:string,name:string,path:string,relation:string,context:string>"


def item_details(graph: CodeGraph, item_id: str, verbose: bool = False) -> DataFrame:
    """One row with all that is known of an item, none if there is no such item: id, path, kind, name, visibility,
    line_start, line_end, code, inbound, outbound (EDGE lists in the order of ids). Unless ``verbose``, the code is null and
    contexts are empty. The lists are as long as the one item's edges."""
    out = item_info(graph, item_id).withColumnRenamed("item_id", "id")
    code = item_code(graph, item_id).select("code") if verbose else None
    out = out.crossJoin(F.broadcast(code.limit(1))) if verbose else out.withColumn("code", F.lit(None).cast("string"))
    for direction in ("inbound", "outbound"):
        context = F.col("context") if verbose else F.lit("")
        edge = F.struct(F.col("item_id").alias("id"), "name", "path", "relation", context.alias("context"))
        edges = item_relations(graph, item_id, direction).agg(F.sort_array(F.collect_list(edge)).alias(direction))
        out = out.crossJoin(F.broadcast(edges))
    return out


def item_lookup(graph: CodeGraph, name: str, kind: str | None = None, root: str = "") -> DataFrame:
    """Items of a name, best first: below the root's src folder, then the shallowest below any src, then by path. ``rank`` is
    shared by ties in the first two; more than one row of rank 1 is an ambiguous name. Ranks come from counts by the first
    two, as many rows as there are depths."""
    found = graph.items.filter(F.col("name") == name)
    found = found if kind is None else found.filter(F.lower("kind") == kind.lower())
    at = F.array_position(paths.parts("path"), "src").cast("int")
    below = F.filter(F.slice(paths.parts("path"), at + 1, F.size(paths.parts("path"))), lambda p: p != "src")
    inside = F.startswith(F.col("path"), F.lit((root.rstrip("/") + "/" if root else "") + "src/"))
    found = found.select("item_id", "path", F.lower("kind").alias("kind"), inside.alias("in_src"), F.when(at > 0, F.size(below)).otherwise(0).alias("depth"))
    counts = found.groupBy("in_src", "depth").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("in_src").desc(), "depth").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("in_src", "depth", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).cast("bigint").alias("rank"))
    return found.join(F.broadcast(ranks), ["in_src", "depth"]).select("item_id", "path", "kind", "in_src", "depth", "rank").orderBy("rank", paths.parts("path"))
