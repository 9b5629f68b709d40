"""Relationships of a graph: containment, module hierarchy, uses by imports, calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, scan
from ..sources.shared import checkpointed
from .resolve import Resolver

# What a call looks like, and the words that make a definition of it.
PATH_CALL = r"(?U)\b([A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+)\s*\("
SIMPLE_CALL = r"(?U)\b([A-Za-z_][A-Za-z0-9_]*)\s*\("
DEFINES = ("fn ", "struct ", "enum ", "trait ")


def edge(source: Column, target: Column, kind: str, detail: Column, strength: float | Column, context: Column) -> list[Column]:
    strength = F.lit(strength) if isinstance(strength, float) else strength
    return [source.alias("from_item"), target.alias("to_item"), F.lit(kind).alias("rel_type"), detail.alias("rel_detail"), strength.cast("double").alias("strength"), context.alias("context")]


def file_id(path: str = "path") -> Column:
    return F.concat(F.lit("file:"), F.col(path))


def file_contains(items: DataFrame) -> DataFrame:
    """A file's own item contains its other items: a projection, no join."""
    return items.filter("ordinal > 0").select(*edge(file_id(), F.col("item_id"), "Contains", F.lit("file_contains"), 1.0, F.lit("auto")))


def module_parents(files: DataFrame) -> DataFrame:
    """(path, parent): mod.rs and lib.rs look one folder up, other files in their own, for mod.rs and then for lib.rs."""
    known = files.select("path").distinct()
    up = F.when(paths.basename("path").isin("mod.rs", "lib.rs"), paths.dirname(paths.dirname("path"))).otherwise(paths.dirname("path"))
    rootless = paths.basename("path").isin("mod.rs", "lib.rs") & ~F.col("path").contains("/")
    probes = known.select("path", F.when(~rootless, paths.joined(up, F.lit("mod.rs"))).alias("first"), F.when(~rootless, paths.joined(up, F.lit("lib.rs"))).alias("second"))
    found = probes.join(known.select(F.col("path").alias("first"), F.col("path").alias("mod")), "first", "left").join(known.select(F.col("path").alias("second"), F.col("path").alias("lib")), "second", "left")
    return found.select("path", F.coalesce("mod", "lib").alias("parent")).filter("parent is not null and parent <> path")


def module_contains(files: DataFrame) -> DataFrame:
    return module_parents(files).select(*edge(file_id("parent"), file_id("path"), "Contains", F.lit("module_contains"), 1.0, F.lit("fs")))


def import_uses(items: DataFrame, imports: DataFrame) -> DataFrame:
    """What each import resolves to, other than the file's own item; repeated imports give repeated edges."""
    targets = Resolver(items, imports).resolve(imports.select("path", F.col("import_path").alias("raw")).distinct())
    hit = imports.join(targets, (imports["path"] == targets["from_path"]) & (imports["import_path"] == targets["raw"])).select(imports["path"], "import_path", "to_item", "is_module")
    hit = hit.filter(F.col("to_item") != file_id())
    return hit.select(*edge(file_id(), F.col("to_item"), "Uses", F.when(F.col("is_module"), "import-module").otherwise("import-item"), F.when(F.col("is_module"), 0.8).otherwise(1.0), F.col("import_path")))


def _first(calls: DataFrame, name: Column) -> DataFrame:
    """(path, name, pos): each name that a file calls once, with the place of its first call. What is joined is as large as
    the distinct names of a file, however often they are called."""
    return calls.groupBy("path", name.alias("called")).agg(F.min("pos").alias("pos"))


def path_calls(files: DataFrame, items: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, to_item, context, pos): resolved path calls; where nothing resolves, functions named like the last part. Of
    equal calls of a file the first counts."""
    calls = files.select("path", F.posexplode(scan.matches(F.coalesce("content", F.lit("")), PATH_CALL, 1)).alias("pos", "m"))
    calls = checkpointed(_first(calls, F.col("m.groups")[1]).withColumnRenamed("called", "raw"))
    targets = Resolver(items, imports).resolve(calls.select("path", "raw"))
    rest = calls.select("path", "raw").join(targets.select(F.col("from_path").alias("path"), "raw").distinct(), ["path", "raw"], "left_anti")
    named = items.filter("kind = 'Function'").select("name", F.col("item_id").alias("to_item"))
    fallback = rest.withColumn("name", F.substring_index("raw", "::", -1)).join(named, "name").select("path", "raw", "to_item")
    every = targets.select(F.col("from_path").alias("path"), "raw", "to_item").unionByName(fallback)
    return calls.join(every, ["path", "raw"]).filter(F.col("to_item") != file_id()).select("path", "to_item", F.col("raw").alias("context"), "pos")


def simple_calls(files: DataFrame, items: DataFrame) -> DataFrame:
    """(path, to_item, context, pos): names before a parenthesis, unless one of DEFINES stands in the 8 bytes before, or an
    exclamation mark is the last character before that is no white space; targets are all functions of the name. Of
    equal calls of a file the first counts."""
    calls = files.select("path", F.posexplode(scan.matches(F.coalesce("content", F.lit("")), SIMPLE_CALL, 1)).alias("pos", "m"))
    window = F.substring(F.encode(F.col("m.before"), "UTF-8"), -8, 8)
    skip = F.col("m.last") == "!"
    for word in DEFINES:
        skip = skip | F.contains(window, F.lit(word.encode()))
    calls = _first(calls.filter(~skip), F.col("m.groups")[1]).withColumnRenamed("called", "name")
    named = items.filter("kind = 'Function'").select("name", F.col("item_id").alias("to_item"))
    return calls.join(named, "name").select("path", "to_item", F.col("name").alias("context"), "pos")


def calls(files: DataFrame, items: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls edges: of each file and target the first, path calls before simple calls, then by position."""
    both = path_calls(files, items, imports).withColumn("phase", F.lit(0)).unionByName(simple_calls(files, items).withColumn("phase", F.lit(1)))
    first = both.groupBy("path", "to_item").agg(F.min(F.struct("phase", "pos", "context")).alias("m"))
    return first.select(*edge(file_id(), F.col("to_item"), "Calls", F.when(F.col("m.phase") == 0, "path").otherwise("heuristic"), F.when(F.col("m.phase") == 0, 0.7).otherwise(0.5), F.col("m.context")))
