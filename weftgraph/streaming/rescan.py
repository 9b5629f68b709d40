"""Listings of source files as a stream: each micro-batch hands on the files that are new or changed.

State is the manifest, a Parquet folder per batch (``batch=<id>``); a batch that is run again after a failure reads the
manifest of the batch before it and replaces its own, so nothing is handed on for a state that was not written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources import cache

MANIFEST = "path string, mtime bigint, len bigint"


def manifest_before(df: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """The latest manifest of a batch before batch_id; empty without one."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
    done = [b for b in done if b < batch_id]
    return spark.read.schema(MANIFEST).parquet(f"{folder}/batch={max(done)}") if done else spark.createDataFrame([], MANIFEST)


def watch(listing: DataFrame, folder: str, changed: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer for a streaming listing (path, mtime, len). Of several rows of a path in a batch the latest counts."""

    def batch(df: DataFrame, batch_id: int) -> None:
        order = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("len"))
        now = df.select("path", "mtime", "len").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
        before = manifest_before(df, folder, batch_id)
        changed(cache.to_parse(before, now), batch_id)
        before.join(now, "path", "left_anti").unionByName(now).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return listing.writeStream.foreachBatch(batch)
