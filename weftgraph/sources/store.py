"""Saved graphs: one Parquet table per part."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import FILES, IMPORTS, ITEMS, RELATIONSHIPS, CodeGraph
from .shared import exactly

_PARTS = {"files": FILES, "items": ITEMS, "imports": IMPORTS, "relationships": RELATIONSHIPS}


def save(graph: CodeGraph, path: str) -> None:
    for name in _PARTS:
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> CodeGraph:
    return CodeGraph(**{name: spark.read.schema(schema).parquet(exactly(f"{path}/{name}")) for name, schema in _PARTS.items()})
