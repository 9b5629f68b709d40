"""What the operators share: the folder that all executors see, written tables, files by URI, and bounds of memory.

Executors may be lost at any time, so nothing here depends on one executor's disk: intermediate tables and output files
go below ``spark.checkpoint.dir``. Where that setting is absent, a temporary folder is set up in local mode, as in tests;
on a cluster that is an error, as executors would each write to a disk of their own.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to Python, a session setting (64 MB unless it is set). A batch is held once by the JVM,
#: outside of its heap, and once by Python, for each task of an executor.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes of the pieces in which Python goes through a batch; the lists of Python objects made of one are several
#: times as large.
PIECE_ROWS, PIECE_BYTES = 1000, 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, its Arrow batches bounded by BATCH_BYTES if they are not already by less. The setting stays: the bound
    is read when a plan runs, which is after the operator that made it has returned."""
    now = spark.conf.get(_BATCH, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def pieces(batches, rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator:
    """The rows of Arrow batches, in slices of at most that many rows and about that many bytes (one row at least)."""
    for b in batches:
        step = max(1, min(rows, int(size * b.num_rows / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


_kept: dict = {}


def kept(owner: str, key: object = None, make: Callable = lambda: None):
    """What an operator keeps in a Python worker between tasks (a memo, a model): make() on first use. A worker keeps one
    operator's things only; those of the operator before it are dropped, as workers outlive the stages of a pipeline."""
    if (owner, key) not in _kept:
        _kept.clear()
        release()
        _kept[owner, key] = make()
        release()
    return _kept[owner, key]


def release() -> None:
    """Gives freed memory back to the system; Arrow's pool and malloc would hold on to it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def release_heaps(spark: SparkSession) -> None:
    """Has the executors collect garbage, after which a JVM gives back most of the heap that is free. A heap that grew in
    one stage of a pipeline otherwise stays as large in the next, beside the Python workers of that one. A task per core;
    an executor that gets none keeps its heap as it is, and no result depends on it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a folder of our own that is then set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the application ends, if not before."""
    path = f"{shared_root(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM has gone already; the folder is left
        return


class Scratch:
    """Tables in the shared folder that are deleted when the ``with`` block ends, but for those written to be kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __call__(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = shared_path(self.spark, name)
        if not keep:
            self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []

    def __exit__(self, *error) -> None:
        self.drop()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts the lineage and fixes what df computed."""
    return Scratch(df.sparkSession)(df, name, keep=True)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI as Hadoop writes it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Writes the chunks under a name of this attempt's own, then renames: a repeated or speculative task replaces
    the file as a whole. Returns the number of bytes."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(part, compression=None) as out:
        for x in chunks:
            out.write(x)
            n += len(x)
    fs.move(part, path)
    return n


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shares(df: DataFrame) -> int:
    """Shuffle partitions set in the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key on more than 1/HOT_SHARE of the rows is looked up by broadcast. There are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left, each row with the one row of right (unique in key) that has its key, or nulls. ``right`` has ``copies``, how
    many of left's rows have the key, and is a written table; rows: how many rows left has. The keys of many rows, at
    most HOT_SHARE by that count, are broadcast and their rows stay where they are; all others are shuffled."""
    names = [c for c in right.columns if c != key]
    hot = right.filter(F.col("copies") * HOT_SHARE > rows).select(key, F.struct(*names).alias("__hot"))
    cold = right.filter(F.col("copies") * HOT_SHARE <= rows).select(key, F.struct(*names).alias("__cold"))
    tried = left.join(F.broadcast(hot), key, "left")
    done = tried.filter(F.col("__hot").isNotNull()).withColumn("__cold", F.col("__hot"))
    rest = tried.filter(F.col("__hot").isNull()).join(cold, key, "left")
    both = done.unionByName(rest)
    return both.select(*left.columns, *[F.col(f"__cold.{c}").alias(c) for c in names])


def matched(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """The inner join that goes with lookup(): rows of left whose key is in right, with right's columns. The hot keys, fewer
    than HOT_SHARE, are collected to tell their rows apart."""
    hot = right.filter(F.col("copies") * HOT_SHARE > rows)
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return left.join(right, key)
    is_hot = F.col(key).isin(keys)
    return left.filter(is_hot).join(F.broadcast(hot), key).unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key))
