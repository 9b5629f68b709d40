from weftgraph.streaming import rescan


def test_only_changed_files_are_handed_on(spark, tmp_path):
    listing, seen = tmp_path / "in", []
    listing.mkdir()

    def run(rows):
        spark.createDataFrame(rows, rescan.MANIFEST).coalesce(1).write.mode("append").parquet(str(listing))
        stream = spark.readStream.schema(rescan.MANIFEST).parquet(str(listing))
        writer = rescan.watch(stream, str(tmp_path / "manifest"), lambda df, _: seen.append(sorted(r.path for r in df.collect())))
        writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run([("a", 1, 1), ("b", 1, 1)])
    run([("a", 1, 1), ("b", 2, 1), ("c", 2, 5)])
    run([("a", 3, 1), ("a", 4, 1), ("b", 2, 1)])
    assert seen == [["a", "b"], ["b", "c"], ["a"]]
