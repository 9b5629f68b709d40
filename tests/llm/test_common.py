from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common


def test_pieces_are_bounded_and_whole():
    texts = ["x" * (i % 50) for i in range(5000)] + ["y" * 300_000, "z"] * 5
    batches = pa.table({"t": texts}).to_batches(max_chunksize=1700)
    got = list(common.pieces(iter(batches), rows=400, size=20_000))
    assert [t for b in got for t in b.column(0).to_pylist()] == texts
    assert max(b.num_rows for b in got) <= 400 and list(common.pieces(iter([batches[0].slice(0, 0)]))) == []


def test_a_worker_keeps_one_operators_things():
    made = []
    for owner, key in (("a", 1), ("a", 1), ("b", 1), ("a", 1), ("a", 2), ("c", None)):
        common.kept(owner, key, lambda: made.append((owner, key)))
    assert made == [("a", 1), ("b", 1), ("a", 1), ("a", 2), ("c", None)] and len(common._kept) == 1


def test_scratch_deletes_what_is_not_kept(spark):
    with common.Scratch(spark) as table:
        one, two = table(spark.range(5), "one"), table(spark.range(7), "two", keep=True)
        assert one.count() == 5
        places = [Path(f.removeprefix("file:")) for df in (one, two) for f in df.inputFiles()[:1]]
    assert not places[0].exists() and two.count() == 7


def test_a_cluster_without_a_shared_folder_is_an_error():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(session)


def test_hot_keys_take_another_way_with_the_same_result(spark):
    """A third of the rows have one key; some keys are on one side only."""
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(1, 6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).join(left.groupBy("k").agg(F.count("*").alias("copies")), "k")
    right = common.written(right, "right")
    want = left.join(right.select("k", "w"), "k", "left")
    for got, expected in ((common.lookup(left, right, "k", 9000).drop("copies"), want), (common.matched(left, right, "k", 9000).drop("copies"), want.filter("w IS NOT NULL")), (common.matched(left, right, "k", 10**9).drop("copies"), want.filter("w IS NOT NULL"))):
        assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, expected.select("k", "v", "w").collect()))
