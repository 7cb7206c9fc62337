"""Connected components: rounds, odd edges, and staged tables that go away."""

from pathlib import Path

from pointflux.operators import graph
from pointflux.storage import new_path, scratch, shared_dir, stage


def test_ascending_path_takes_few_rounds(spark, monkeypatch):
    hooks = []
    monkeypatch.setattr(graph, "new_path", lambda s, name: hooks.append(name) or new_path(s, name))
    got = graph.components(spark.range(1000).selectExpr("id AS a", "id + 1 AS b")).collect()
    assert len(got) == 1001 and all(r.root == 0 for r in got) and hooks.count("hook") <= 15


def test_odd_edges(spark):
    star = [(1000 + i, 1000) for i in range(1, 60)]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame([*star, (5, 5), (7, 6), (6, 7), (7, None), (None, None)], "a long, b long")).collect()}
    assert got == {6: 6, 7: 6, **{1000 + i: 1000 for i in range(60)}}
    words = graph.components(spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")).collect()
    assert {r.v: r.root for r in words} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_deletes_what_it_staged(spark):
    keep, top = new_path(spark, "kept"), Path(shared_dir(spark).removeprefix("file://"))
    before = set(top.iterdir())
    with scratch(spark):
        stage(spark.range(3), "gone").write.parquet(keep)
        graph.components(spark.range(3).selectExpr("id AS a", "id + 1 AS b"))
        assert len(set(top.iterdir()) - before) >= 3
    assert set(top.iterdir()) - before == {Path(keep.removeprefix("file://"))} and spark.read.parquet(keep).count() == 3
