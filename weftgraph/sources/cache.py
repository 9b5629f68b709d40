"""Incremental scans: a manifest (path, mtime, len) tells which files have to be parsed again.

A stored cache is a folder with a generation per build (``gen-<n>``): files, items and imports as Parquet. A build writes a
generation of its own and deletes the others when it is complete, so a build that fails leaves the one before it, and no
table is read and replaced at once. The folder is read and written by Spark, so it may be in any shared store."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FILES, IMPORTS, ITEMS
from .shared import exactly

_PARTS = {"files": FILES, "items": ITEMS, "imports": IMPORTS}


class CacheMode(Enum):
    USE = "use"  # unchanged files are taken from the cache
    IGNORE = "ignore"  # all files are parsed; the cache is written anew
    REBUILD = "rebuild"  # the cache is cleared first, then as IGNORE


@dataclass
class Parsed:
    files: DataFrame
    items: DataFrame
    imports: DataFrame


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state): new, changed (another mtime or length), gone, or same."""
    old = before.select("path", F.struct("mtime", "len").alias("old"))
    new = now.select("path", F.struct("mtime", "len").alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return old.join(new, "path", "full").select("path", state.alias("state"))


def to_parse(before: DataFrame, now: DataFrame) -> DataFrame:
    """Rows of now that a former scan does not cover."""
    return now.join(before.select("path", "mtime", "len"), ["path", "mtime", "len"], "left_anti")


def reusable(parsed: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Parsed rows (with path) of files that are unchanged; rows of vanished files are left out."""
    same = before.join(now.select("path", "mtime", "len"), ["path", "mtime", "len"], "left_semi").select("path").distinct()
    return parsed.join(same, "path", "left_semi")


def merged(before: Parsed, now: DataFrame, fresh: Parsed) -> Parsed:
    """What a former scan has of unchanged files, and the fresh parts of all others."""
    return Parsed(*[reusable(getattr(before, p), before.files, now).unionByName(getattr(fresh, p)) for p in _PARTS])


def _generations(spark: SparkSession, folder: str):
    """(file system, {number: path} of complete generations, all paths)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    every = {int(s.getPath().getName()[4:]): s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("gen-")} if fs.exists(root) else {}
    done = {n: p for n, p in every.items() if all(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, f"{part}/_SUCCESS")) for part in _PARTS)}
    return fs, done, every


def load(spark: SparkSession, folder: str) -> Parsed | None:
    """The latest complete generation, or None."""
    _, done, _ = _generations(spark, folder)
    if not done:
        return None
    path = done[max(done)].toString()
    return Parsed(*[spark.read.schema(schema).parquet(exactly(f"{path}/{part}")) for part, schema in _PARTS.items()])


def save(spark: SparkSession, folder: str, parsed: Parsed) -> Parsed:
    """Writes a generation, deletes the others, and returns the parts as they were written."""
    fs, _, every = _generations(spark, folder)
    path = f"{folder}/gen-{max(every, default=0) + 1}"
    for part in _PARTS:
        getattr(parsed, part).write.parquet(f"{path}/{part}")
    for old in every.values():
        fs.delete(old, True)
    return Parsed(*[spark.read.schema(schema).parquet(exactly(f"{path}/{part}")) for part, schema in _PARTS.items()])


def clear(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
