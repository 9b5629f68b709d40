"""The graph as DataFrames.

files(path, content, mtime, len), items(path, ordinal, item_id, kind, name, visibility, vis_scope, line_start, line_end,
attrs), imports(path, ordinal, import_path, alias), relationships(from_item, to_item, rel_type, rel_detail, strength,
context). Item ids may repeat over files; ``item_owner`` has one row per id, that of the greatest path by component."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import paths

ATTRS = "struct<is_inline:boolean,is_async:boolean,is_const:boolean,is_tuple:boolean,is_object_safe:boolean,is_mut:boolean,variant_count:bigint,trait_name:string,type_name:string>"
FILES = "path string, content string, mtime bigint, len bigint"
ITEMS = f"path string, ordinal int, item_id string, kind string, name string, visibility string, vis_scope string, line_start bigint, line_end bigint, attrs {ATTRS}"
IMPORTS = "path string, ordinal int, import_path string, alias string"
RELATIONSHIPS = "from_item string, to_item string, rel_type string, rel_detail string, strength double, context string"


@dataclass
class CodeGraph:
    files: DataFrame
    items: DataFrame
    imports: DataFrame
    relationships: DataFrame

    def item_owner(self, items: DataFrame | None = None) -> DataFrame:
        """(item_id, path), one row per id: joins never fan out. Partial aggregates run before the shuffle. ``items``: all
        items of the ids that are asked for, where not all are."""
        last = F.max(F.struct(paths.parts("path").alias("key"), F.col("path").alias("path")))
        return (self.items if items is None else items).groupBy("item_id").agg(last["path"].alias("path"))

    def file_edges(self) -> DataFrame:
        """(src_path, dst_path, rel_type): relationships between known files, without loops; multi-edges are kept.
        Edges of equal ends and type are counted first (n), so what is joined is as large as the distinct edges."""
        edges = self.relationships.groupBy("from_item", "to_item", "rel_type").agg(F.count(F.lit(1)).alias("n"))
        owner = self.item_owner()
        src = owner.select(F.col("item_id").alias("from_item"), F.col("path").alias("src_path"))
        dst = owner.select(F.col("item_id").alias("to_item"), F.col("path").alias("dst_path"))
        return edges.join(src, "from_item").join(dst, "to_item").filter("src_path <> dst_path").select("src_path", "dst_path", "rel_type", "n")
