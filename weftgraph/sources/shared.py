"""Lineage is cut in the folder all executors share: spark.checkpoint.dir, or one of our own where that is
unset in local mode; on a cluster that is an error, as each executor would write to a disk of its own."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def exactly(path: str) -> str:
    """A path for Spark's readers, which take some characters for patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()
