"""Graphs made of relational tables: nations as files, suppliers, customers and parts as items, trade as calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import CodeGraph
from ..operators import extract, relate


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.format_string("src/r%d/n%d.rs", "n_regionkey", "n_nationkey").alias("path"))


def _brand_file(brand: str) -> Column:
    return F.concat(F.lit("src/parts/"), F.replace(F.lower(brand), F.lit("#"), F.lit("")), F.lit(".rs"))


def trade_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The whole graph; multi-edges on purpose (a call per line item)."""
    nation, region = _nation_file(spark, sf_dir), _table(spark, sf_dir, "region")
    supplier, customer, part = (_table(spark, sf_dir, t) for t in ("supplier", "customer", "part"))
    rows = [spark.createDataFrame([("src/lib.rs",), ("src/parts/mod.rs",)], "path string"), region.select(F.format_string("src/r%d/mod.rs", "r_regionkey").alias("path")), nation.select("path"), part.select(_brand_file("p_brand").alias("path")).distinct()]
    files = rows[0]
    for r in rows[1:]:
        files = files.unionByName(r)
    files = files.select("path", F.lit("").alias("content"), F.lit(0).cast("bigint").alias("mtime"), F.lit(0).cast("bigint").alias("len"))

    def kind(df: DataFrame, key: str, nation_key: str | None, word: str, kind: str, prefix: str) -> DataFrame:
        df = df.join(nation, df[nation_key] == nation["n_nationkey"]) if nation_key else df.withColumn("path", _brand_file("p_brand"))
        k = F.col(key)
        vis = F.when(k % 3 == 0, "Public").when(k % 3 == 1, "Private").otherwise("PubCrate")
        line = k.cast("bigint")
        return df.select("path", k.cast("int").alias("ordinal"), F.concat(F.lit(f"{prefix}:{word}_"), k, F.lit(":"), k).alias("item_id"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{word}_"), k).alias("name"), vis.alias("visibility"), F.lit(None).cast("string").alias("vis_scope"), line.alias("line_start"), line.alias("line_end"), extract.attributes().alias("attrs"))

    items = extract.file_items(files)
    items = items.unionByName(kind(supplier.withColumn("s_suppkey", F.col("s_suppkey") + 1), "s_suppkey", "s_nationkey", "supplier", "Function", "fn"))
    items = items.unionByName(kind(customer.withColumn("c_custkey", F.col("c_custkey") + 1), "c_custkey", "c_nationkey", "customer", "Struct", "struct"))
    items = items.unionByName(kind(part.withColumn("p_partkey", F.col("p_partkey") + 1), "p_partkey", None, "part", "Enum", "enum"))
    contains = relate.file_contains(items).unionByName(relate.module_contains(files))
    return CodeGraph(files, items, spark.createDataFrame([], "path string, ordinal int, import_path string, alias string"), contains.unionByName(_trade(spark, sf_dir)))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls: the customer's nation calls the supplier, once per line item. Uses: the supplier's nation uses each part it
    supplies, once."""
    nation = _nation_file(spark, sf_dir)
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == nation["n_nationkey"]).select("c_custkey", "path")
    supplier = _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == nation["n_nationkey"]).select("s_suppkey", "path")
    call = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    k, p = F.col("l_suppkey") + 1, F.col("l_partkey") + 1
    calls = call.select(*relate.edge(relate.file_id(), F.concat(F.lit("fn:supplier_"), k, F.lit(":"), k), "Calls", F.lit("trade"), 0.5, F.lit("")))
    use = line.select("l_suppkey", "l_partkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("path", "l_partkey").distinct()
    uses = use.select(*relate.edge(relate.file_id(), F.concat(F.lit("enum:part_"), p, F.lit(":"), p), "Uses", F.lit("import-item"), 1.0, F.lit("")))
    return calls.unionByName(uses)


def supplied_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses: each supplier, as a function, uses each part it supplies, once."""
    line = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey") + 1, F.col("l_partkey") + 1).distinct().toDF("k", "p")
    return line.select(*relate.edge(F.concat(F.lit("fn:supplier_"), "k", F.lit(":"), "k"), F.concat(F.lit("enum:part_"), "p", F.lit(":"), "p"), "Uses", F.lit("import-item"), 1.0, F.lit("")))


def ring_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """A file per supplier, in blocks of six, each calling the next; in blocks of even number the last calls the first, in
    the others it calls the first of the next block. It grows with the suppliers."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.floor(F.col("s_suppkey") / 6).cast("int").alias("b"))
    path = lambda k: F.format_string("file:src/b%d/s%d.rs", F.floor(k / 6).cast("int"), k.cast("int"))
    top = s.groupBy("b").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    odd, last = F.col("b") % 2 == 1, F.col("k") == F.col("high")
    to = s.join(top, "b").withColumn("to", F.when(last & ~odd, F.col("low")).otherwise(F.col("k") + 1))
    edges = to.join(s.select(F.col("k").alias("to")), "to").filter("k <> to").select(*relate.edge(path(F.col("k")), path(F.col("to")), "Calls", F.lit("test"), 0.5, F.lit("")))
    files = s.select(F.substring(path(F.col("k")), F.lit(6), F.lit(1000)).alias("path"), F.lit("").alias("content"), F.lit(0).cast("bigint").alias("mtime"), F.lit(0).cast("bigint").alias("len"))
    return CodeGraph(files, extract.file_items(files), spark.createDataFrame([], "path string, ordinal int, import_path string, alias string"), edges)


def sparse_trade_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Nations only; each calls the two foreign nations whose suppliers it buys from most."""
    nation = _nation_file(spark, sf_dir)
    line, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    trade = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = trade.filter("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").count()
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("count"), "s_nationkey"))).filter("k <= 2")
    a, b = (nation.select(F.col("n_nationkey").alias(c), F.concat(F.lit("file:"), "path").alias(e)) for c, e in (("c_nationkey", "a"), ("s_nationkey", "b")))
    edges = top.join(a, "c_nationkey").join(b, "s_nationkey").select(*relate.edge(F.col("a"), F.col("b"), "Calls", F.lit("trade"), 0.5, F.lit("")))
    files = nation.select("path", F.lit("").alias("content"), F.lit(0).cast("bigint").alias("mtime"), F.lit(0).cast("bigint").alias("len"))
    return CodeGraph(files, extract.file_items(files), spark.createDataFrame([], "path string, ordinal int, import_path string, alias string"), edges)


def supplier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files, one per supplier and one per nation: every form the extractor has to take or to leave."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    s = s.withColumn("j", F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    text = F.concat(
        F.when(F.col("j").isNotNull(), F.format_string("use crate::m%d::s%d::f%d;\n", "s_nationkey", "j", "j")).otherwise(""),
        F.format_string("use crate::m%d::top%d as up%d;\nuse a::{b, c};\n\n\n", "s_nationkey", "s_nationkey", "s_suppkey"),
        F.when(F.col("j").isNotNull(), F.format_string("pub fn f%d() { f%d(); crate::m%d::s%d::f%d(); if !run%d() {} }\n", "s_suppkey", "j", "s_nationkey", "j", "j", "j")).otherwise(F.format_string("pub fn f%d() { up%d(); super::top%d(); }\n", "s_suppkey", "s_suppkey", "s_nationkey")),
        F.format_string("\nstruct S%d { a: u8 }\npub(crate) enum E%d { A, B }\nfn generic<T>(x: T) {}\n\npub(in crate::m%d) async fn run%d() { top%d(); }\n", "s_suppkey", "s_suppkey", "s_nationkey", "s_suppkey", "s_nationkey"),
    )
    files = s.select(F.format_string("src/m%d/s%d.rs", "s_nationkey", "s_suppkey").alias("path"), text.alias("content"))
    n = _table(spark, sf_dir, "nation")
    files = files.unionByName(n.select(F.format_string("src/m%d/mod.rs", "n_nationkey").alias("path"), F.format_string("pub fn top%d() {}\n", "n_nationkey").alias("content")))
    files = files.unionByName(spark.createDataFrame([("src/lib.rs", "pub mod shared;\n")], "path string, content string"))
    return files.select("path", "content", F.lit(0).cast("bigint").alias("mtime"), F.length("content").cast("bigint").alias("len"))


def chain_project(spark: SparkSession, n: int) -> DataFrame:
    """n files f{i}.rs, each calling the one before, and lib.rs."""
    rows = spark.range(n).select(F.format_string("src/f%d.rs", "id").alias("path"), F.when(F.col("id") == 0, F.lit("pub fn f0() {}\n")).otherwise(F.format_string("use crate::f%d::f%d;\npub fn f%d() { f%d(); }\n", F.col("id") - 1, F.col("id") - 1, "id", F.col("id") - 1)).alias("content"))
    rows = rows.unionByName(spark.createDataFrame([("src/lib.rs", "pub mod f0;\n")], "path string, content string"))
    return rows.select("path", "content", F.lit(0).cast("bigint").alias("mtime"), F.length("content").cast("bigint").alias("len"))
