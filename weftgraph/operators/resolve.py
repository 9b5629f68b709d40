"""Names in imports and calls to items: a cascade of joins, each with one winner.

The folder reached after k parts is the start folder and the first k parts whatever they are, so the walk along a path
needs no iteration: prefixes are exploded, checked by one join against the folders that hold modules, and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.shared import checkpointed

_HEAD = ("crate", "self", "super")


class Resolver:
    def __init__(self, items: DataFrame, imports: DataFrame):
        self.items, self.imports = items, imports
        last = lambda value: F.max(F.struct(paths.parts("path"), F.col("ordinal"), value.alias("v")))["v"]
        segments = paths.import_segments("import_path")
        self.names = items.select("name", F.col("item_id").alias("to_item"), (F.col("ordinal") == 0).alias("is_module"))
        self.modules = items.filter("ordinal = 0").groupBy("name").agg(last(F.col("item_id")).alias("module_item"))
        self.aliases = imports.filter("alias is not null and alias <> '_'").groupBy(F.col("alias").alias("head")).agg(last(segments).alias("alias_parts"))
        plain = imports.filter("alias is null or alias = '_'").withColumn("head", F.try_element_at(segments, F.lit(-1)))
        self.exposed = plain.groupBy(F.col("path").alias("from_path"), "head").agg(F.max(F.struct("ordinal", segments.alias("v")))["v"].alias("exposed_parts"))
        files = items.filter("ordinal = 0").select("path").distinct()
        folders = files.filter(paths.basename("path").isin("mod.rs", "lib.rs")).select(paths.dirname("path").alias("folder"))
        leaves = files.filter(F.col("path").endswith(".rs")).select(F.regexp_replace("path", r"\.rs$", "").alias("folder"))
        self.folders = folders.unionByName(leaves).distinct()

    @staticmethod
    def _normal(from_path: Column, raw: Column) -> Column:
        """struct(scope, parts): the leading run of crate, self and super applied to the file's module path."""
        first = F.regexp_replace(F.split_part(raw, F.lit(" as "), F.lit(1)), r"(?U)^\s+|\s+$", "")
        segments = paths.import_segments(first)
        zero = F.struct(paths.module_segments(from_path).alias("scope"), F.array().cast("array<string>").alias("parts"))

        def step(a: Column, s: Column) -> Column:
            lead = F.size(a["parts"]) == 0
            scope = F.when(lead & (s == "crate"), F.array().cast("array<string>")).when(lead & (s == "super"), F.slice(a["scope"], 1, F.greatest(F.lit(0), F.size(a["scope"]) - 1))).otherwise(a["scope"])
            return F.struct(scope.alias("scope"), F.when(lead & s.isin(*_HEAD), a["parts"]).otherwise(F.array_append(a["parts"], s)).alias("parts"))

        return F.aggregate(segments, zero, step)

    def resolve(self, refs: DataFrame) -> DataFrame:
        """refs: distinct (path, raw). Returns (from_path, raw, to_item, is_module)."""
        refs = refs.select(F.col("path").alias("from_path"), "raw", self._normal(F.col("path"), F.col("raw")).alias("n"))
        refs = refs.select("from_path", "raw", "n.scope", "n.parts").filter(F.size("parts") > 0)
        rest = lambda: F.slice("parts", 2, F.greatest(F.lit(0), F.size("parts") - 1))
        refs = refs.withColumn("head", F.col("parts")[0]).join(self.aliases, "head", "left")
        refs = refs.withColumn("parts", F.when(F.col("alias_parts").isNotNull(), F.concat("alias_parts", rest())).otherwise(F.col("parts"))).drop("alias_parts")
        refs = refs.withColumn("head", F.col("parts")[0]).join(self.exposed, ["from_path", "head"], "left")
        refs = refs.withColumn("parts", F.when(F.col("exposed_parts").isNotNull(), F.concat("exposed_parts", rest())).otherwise(F.col("parts"))).drop("exposed_parts", "head")
        refs = checkpointed(refs.withColumn("last", F.element_at("parts", -1)))
        hits = checkpointed(self._scoped(refs))
        missed = refs.join(hits.select("from_path", "raw").distinct(), ["from_path", "raw"], "left_anti")
        named = missed.join(self.names, missed["last"] == self.names["name"]).select("from_path", "raw", "to_item", "is_module")
        return hits.unionByName(named)

    def _scoped(self, refs: DataFrame) -> DataFrame:
        leaf = ~paths.basename("from_path").isin("mod.rs", "lib.rs") & (F.size("scope") > 0)
        scope = F.when(leaf, F.slice("scope", 1, F.greatest(F.lit(0), F.size("scope") - 1))).otherwise(F.col("scope"))
        start = F.concat(F.array(paths.source_root("from_path")), scope)
        refs = refs.filter(paths.source_root("from_path").isNotNull()).withColumn("start", start)
        n = F.size("parts")
        at = lambda k: F.array_join(F.concat(F.col("start"), F.slice("parts", 1, k)), "/")
        refs = refs.withColumn("dir", at(n - 1))
        steps = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda k: F.array_join(F.concat(F.col("start"), F.slice("parts", 1, k)), "/"))).otherwise(F.array().cast("array<string>"))
        walk = refs.select("from_path", "raw", "last", "dir", n.alias("n"), F.explode_outer(steps).alias("folder"))
        known = self.folders.withColumn("ok", F.lit(1))
        walk = walk.join(known, "folder", "left").groupBy("from_path", "raw", "last", "dir", "n").agg(F.sum("ok").alias("found"))
        walk = walk.filter((F.col("n") == 1) | (F.col("found") == F.col("n") - 1))
        tries = walk.select("from_path", "raw", "last", F.posexplode(F.array(F.concat("dir", F.lit("/"), "last", F.lit(".rs")), F.concat("dir", F.lit("/mod.rs")), F.concat("dir", F.lit("/lib.rs")))).alias("turn", "path"))
        inside = self.items.select("path", F.col("name").alias("last"), F.col("item_id").alias("to_item"), (F.col("ordinal") == 0).alias("is_module"))
        direct = tries.join(inside, ["path", "last"]).withColumn("turn", F.col("turn") * 2)
        there = self.items.filter("ordinal = 0").select("path")
        module = tries.filter("turn = 0").join(there, "path").join(self.modules.withColumnRenamed("name", "last"), "last").select("path", "last", "from_path", "raw", F.lit(1).alias("turn"), F.col("module_item").alias("to_item"), F.lit(True).alias("is_module"))
        both = direct.select("from_path", "raw", "turn", "to_item", "is_module").unionByName(module.select("from_path", "raw", "turn", "to_item", "is_module"))
        best = Window.partitionBy("from_path", "raw")
        return both.withColumn("best", F.min("turn").over(best)).filter("turn = best").select("from_path", "raw", "to_item", "is_module")
