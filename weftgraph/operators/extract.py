"""Items and imports of source files: table functions over ``files(path, content)``, all in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, scan
from ..model import ATTRS

# The grammar of items and imports. (?mdU): ^ and $ at line ends (\n only), Unicode classes.
_VIS = r"(pub(?:\([^)]*\))?\s+)?"
PATTERNS = {
    "Function": r"(?mdU)^\s*" + _VIS + r"(?:async\s+)?(?:const\s+)?fn\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
    "Struct": r"(?mdU)^\s*" + _VIS + r"struct\s+([A-Za-z_][A-Za-z0-9_]*)",
    "Enum": r"(?mdU)^\s*" + _VIS + r"enum\s+([A-Za-z_][A-Za-z0-9_]*)",
}
IMPORT = r"(?mdU)^\s*(?:pub\s+)?use\s+([^;{]+?)(?:\s+as\s+([A-Za-z_][A-Za-z0-9_]*))?\s*;\s*$"
PREFIX = {"Function": "fn", "Struct": "struct", "Enum": "enum"}


def visibility(text: Column) -> Column:
    """Public, Private, PubCrate, PubSuper or PubIn of a visibility prefix."""
    t = F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    scope = F.regexp_extract(t, r"^pub\(([^)]+)\)$", 1)
    return F.when(t == "", "Private").when(t == "pub", "Public").when(scope == "crate", "PubCrate").when(scope == "super", "PubSuper").when(scope != "", "PubIn").otherwise("Private")


def visibility_scope(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    scope = F.regexp_extract(t, r"^pub\(([^)]+)\)$", 1)
    return F.when((visibility(text) == "PubIn"), scope)


def attributes(**known: Column) -> Column:
    fields = [x.split(":") for x in ATTRS[len("struct<") : -1].split(",")]
    return F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def _found(kind: str) -> Column:
    """All matches of a kind in ``content``, with their kind."""
    return F.transform(scan.matches(F.coalesce("content", F.lit("")), PATTERNS[kind], 2), lambda m: F.struct(F.lit(kind).alias("kind"), m["groups"].alias("g"), m["line"].alias("line")))


def _columns() -> list[Column]:
    """The columns of items from a match ``m``."""
    kind, g, line = F.col("m.kind"), F.col("m.g"), F.col("m.line")
    function = kind == "Function"
    attrs = attributes(is_async=F.when(function, F.contains(g[0], F.lit("async "))), is_const=F.when(function, F.contains(g[0], F.lit("const "))), is_tuple=F.when(kind == "Struct", F.lit(False)), variant_count=F.when(kind == "Enum", F.lit(0)))
    prefix = F.when(function, PREFIX["Function"]).when(kind == "Struct", PREFIX["Struct"]).otherwise(PREFIX["Enum"])
    return [F.concat_ws(":", prefix, g[2], line).alias("item_id"), kind.alias("kind"), g[2].alias("name"), visibility(g[1]).alias("visibility"), visibility_scope(g[1]).alias("vis_scope"), line.alias("line_start"), line.alias("line_end"), attrs.alias("attrs")]


def items_of(files: DataFrame, kind: str) -> DataFrame:
    """One kind's items in text order: path, pos, and the columns of items."""
    return files.select("path", F.posexplode(_found(kind)).alias("pos", "m")).select("path", "pos", *_columns())


def file_items(files: DataFrame) -> DataFrame:
    """The synthetic item of each file, ordinal 0."""
    one = F.lit(1).cast("bigint")
    return files.select("path", F.lit(0).alias("ordinal"), F.concat(F.lit("file:"), "path").alias("item_id"), F.lit("Module").alias("kind"), F.coalesce(F.nullif(paths.stem("path"), F.lit("")), F.lit("(file)")).alias("name"), F.lit("PubCrate").alias("visibility"), F.lit(None).cast("string").alias("vis_scope"), one.alias("line_start"), one.alias("line_end"), attributes(is_inline=F.lit(False)).alias("attrs"))


def items(files: DataFrame) -> DataFrame:
    """All items: the file's own, then functions, structs and enums, each in text order. A file is searched once per
    kind, and an item's place in the list of all matches is its ordinal, so nothing is shuffled."""
    found = files.select("path", F.posexplode(F.concat(*[_found(k) for k in PATTERNS])).alias("pos", "m"))
    return file_items(files).unionByName(found.select("path", (F.col("pos") + 1).alias("ordinal"), *_columns()))


def imports(files: DataFrame) -> DataFrame:
    """path, ordinal, import_path, alias."""
    found = files.select("path", F.posexplode(scan.matches(F.coalesce("content", F.lit("")), IMPORT, 2)).alias("ordinal", "m"))
    g = F.col("m.groups")
    return found.select("path", F.col("ordinal").cast("int").alias("ordinal"), F.regexp_replace(g[1], r"(?U)^\s+|\s+$", "").alias("import_path"), F.nullif(g[2], F.lit("")).alias("alias"))


def metrics(items: DataFrame, imports: DataFrame) -> DataFrame:
    """path, item_count (with the file's own item), import_count."""
    n = items.groupBy("path").agg(F.count(F.lit(1)).alias("item_count"))
    m = imports.groupBy("path").agg(F.count(F.lit(1)).alias("import_count"))
    return n.join(m, "path", "left").select("path", "item_count", F.coalesce("import_count", F.lit(0)).alias("import_count"))
