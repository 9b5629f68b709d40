"""Graphs as one JSON document, for exchange; ``store`` (Parquet) is the form for large graphs.

The document is written file by file and edge by edge, so the writer holds one file's items at a time, and the edges'
rows as they arrive. Reading takes the whole document, as JSON has no other way; it is bounded by what a driver holds.
Source texts are not part of a document: files read from one have null contents, as they have null times and lengths.
Of files of equal path the last stays. A document that is not one raises ValueError."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..model import FILES, IMPORTS, ITEMS, RELATIONSHIPS, CodeGraph
from ..operators.relate import module_parents

# Fixed values of the format: the fields that a kind of item or relationship carries.
KIND_FIELDS = {"Module": ["is_inline"], "Function": ["is_async", "is_const"], "Struct": ["is_tuple"], "Enum": ["variant_count"], "Trait": ["is_object_safe"], "Impl": ["trait_name", "type_name"], "Const": [], "Static": ["is_mut"], "Type": [], "Macro": []}
DETAIL_FIELDS = {"Uses": "import_type", "Implements": "trait_name", "Contains": "containment_type", "Extends": "extension_type", "Calls": "call_type"}
ATTRS = ["is_inline", "is_async", "is_const", "is_tuple", "is_object_safe", "is_mut", "variant_count", "trait_name", "type_name"]
_MISSING = {"variant_count": 0, "trait_name": None, "type_name": ""}


def _item(r) -> dict:
    fields, attrs = KIND_FIELDS[r["kind"]], r["attrs"].asDict() if r["attrs"] else {}
    values = {f: _MISSING.get(f, False) if attrs.get(f) is None else attrs[f] for f in fields}
    visibility = {"PubIn": r["vis_scope"] or ""} if r["visibility"] == "PubIn" else r["visibility"]
    location = {"file": r["path"], "line_start": r["line_start"], "line_end": r["line_end"]}
    return {"id": r["item_id"], "item_type": {r["kind"]: values} if fields else r["kind"], "name": r["name"], "visibility": visibility, "location": location, "attributes": []}


def _file(r) -> dict:
    items = [_item(x) for x in r["items"] or []]
    imports = [{"path": x["import_path"], "alias": x["alias"]} for x in r["imports"] or []]
    return {"path": r["path"], "items": items, "imports": imports, "metrics": {"item_count": len(items), "import_count": len(imports)}}


def _edge(r) -> dict:
    return {"from_item": r["from_item"], "to_item": r["to_item"], "relationship_type": {r["rel_type"]: {DETAIL_FIELDS[r["rel_type"]]: r["rel_detail"]}}, "strength": r["strength"], "context": r["context"]}


def _grouped(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in rows.columns if c != "ordinal"]))).alias(name))


def parts(graph: CodeGraph, generated_at: str | None = None):
    """The document in pieces of text. generated_at: now, in seconds since 1970, if it is not given."""

    def entries(rows, key=None):
        for n, (k, v) in enumerate(rows):
            yield ("," if n else "") + "\n    " + (json.dumps(k, ensure_ascii=False) + ": " if key else "") + json.dumps(v, ensure_ascii=False)

    known = graph.files.select("path").distinct()
    files = known.join(_grouped(graph.items, "items"), "path", "left").join(_grouped(graph.imports, "imports"), "path", "left").orderBy(paths.parts("path"))
    hierarchy = module_parents(graph.files).filter("parent IS NOT NULL").select("path", "parent").distinct()
    below = hierarchy.groupBy("parent").agg(F.sort_array(F.collect_set("path")).alias("children")).orderBy("parent")
    segments = known.select("path", paths.module_segments("path").alias("segments")).orderBy("path")
    yield '{\n  "files": {'
    yield from entries(((r["path"], _file(r)) for r in files.toLocalIterator()), True)
    yield '\n  },\n  "relationships": ['
    yield from entries((None, _edge(r)) for r in graph.relationships.orderBy("from_item", "rel_type", "to_item", "context").toLocalIterator())
    yield '\n  ],\n  "metadata": ' + json.dumps({"generated_at": str(int(time.time())) if generated_at is None else generated_at})
    for name, rows in (("module_parent", hierarchy.orderBy("path")), ("module_children", below), ("module_segments", segments)):
        yield f',\n  "{name}": {{'
        yield from entries(((r[0], r[1]) for r in rows.toLocalIterator()), True)
        yield "\n  }"
    yield "\n}\n"


def save(graph: CodeGraph, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(parts(graph))


def _tagged(value) -> tuple[str, dict | str]:
    return next(iter(value.items())) if isinstance(value, dict) else (value, {})


def load(spark: SparkSession, path: str) -> CodeGraph:
    try:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        files, items, imports, edges = [], [], [], []
        for name, node in whole["files"].items():
            files.append((name, None, None, None))
            for n, x in enumerate(node["items"]):
                kind, attrs = _tagged(x["item_type"])
                visibility, scope = _tagged(x["visibility"])
                at = x["location"]
                items.append((name, n, x["id"], kind, x["name"], visibility, scope or None, at["line_start"], at["line_end"], tuple(attrs.get(a) for a in ATTRS)))
            imports += [(name, n, x["path"], x["alias"]) for n, x in enumerate(node["imports"])]
        for x in whole["relationships"]:
            kind, detail = _tagged(x["relationship_type"])
            edges.append((x["from_item"], x["to_item"], kind, next(iter(detail.values()), None), float(x["strength"]), x["context"]))
    except (KeyError, TypeError, AttributeError, StopIteration) as e:
        raise ValueError(f"{path}: not a graph document ({e!r})") from e
    return CodeGraph(*[spark.createDataFrame(rows, schema) for rows, schema in ((files, FILES), (items, ITEMS), (imports, IMPORTS), (edges, RELATIONSHIPS))])
