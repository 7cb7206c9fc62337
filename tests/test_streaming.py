"""The change feed on a stream of files, one micro-batch a file."""

from pointflux.streaming import label_changes


def test_changes_across_micro_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder, schema = str(tmp_path / "in"), "track long, at long, label string"
    batches = [[(1, 0, "a"), (1, 1, "a"), (2, 0, None), (1, 2, "b")], [(1, 3, "b"), (2, 1, None), (2, 2, "x")], [(1, 5, "b"), (1, 4, "a"), (3, 0, "x")]]
    feed = label_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), "track", "at", "label")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        query = feed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert sorted(got, key=str) == sorted([(1, 0, "a"), (1, 2, "b"), (2, 0, None), (2, 2, "x"), (1, 4, "a"), (1, 5, "b"), (3, 0, "x")], key=str)
