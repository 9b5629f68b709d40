"""files to CodeGraph: extraction, hierarchy, uses, calls.

Files are parsed once; items and imports are written to the shared folder, as every later step reads them several times.
The relationships are one lazy plan over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import CodeGraph
from ..operators import extract, relate
from ..sources import cache, tree
from ..sources.cache import CacheMode, Parsed
from ..sources.shared import checkpointed

CACHE_FOLDER = ".weftgraph_cache"


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, items, imports), each computed and written down once."""
    files = checkpointed(files)
    return files, checkpointed(extract.items(files)), checkpointed(extract.imports(files))


def _graph(files: DataFrame, items: DataFrame, imports: DataFrame) -> CodeGraph:
    edges = relate.file_contains(items).unionByName(relate.module_contains(files)).unionByName(relate.import_uses(items, imports)).unionByName(relate.calls(files, items, imports))
    return CodeGraph(files, items, imports, checkpointed(edges))


def build(files: DataFrame) -> CodeGraph:
    return _graph(*parsed(files))


def refreshed(before: Parsed | None, now: DataFrame, files: DataFrame) -> Parsed:
    """now: the listing (path, mtime, len); files: those of it that before does not cover, with their contents."""
    fresh = Parsed(*parsed(files))
    return fresh if before is None else cache.merged(before, now, fresh)


def build_tree(spark: SparkSession, root: str, mode: CacheMode = CacheMode.USE, ignore_rules: bool = True, folder: str | None = None) -> CodeGraph:
    """The graph of a source tree. The cache below its root (or in ``folder``) spares unchanged files of being read and
    parsed; files that are gone leave it. Every mode writes it."""
    folder = folder or f"{root.rstrip('/')}/{CACHE_FOLDER}"
    if mode is CacheMode.REBUILD:
        cache.clear(spark, folder)
    listing = tree.discover(root, ignore_rules)
    now = spark.createDataFrame(listing, tree.LISTING)
    before = cache.load(spark, folder) if mode is CacheMode.USE else None
    todo = listing if before is None else [tuple(r) for r in cache.to_parse(before.files, now).select("path", "mtime", "len").collect()]
    found = cache.save(spark, folder, refreshed(before, now, tree.read(spark, todo)))
    return _graph(found.files, found.items, found.imports)
