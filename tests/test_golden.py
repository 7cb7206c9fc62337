"""Hand-computed results of small clips, selections, edits and encodings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointflux.functions import numeric as N
from pointflux.functions import quaternion as Q
from pointflux.operators import boundary, fits, layout, sampling, selection, stats, temporal


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_two_point_clip(spark):
    inf = float("inf")
    rows = [(0, 0, 0.0), (0, 2, 10.0), (1, 0, 0.0), (1, 2, -inf)]
    keys = spark.createDataFrame(rows, "track long, frame int, value double")
    got = {r.track: r.value for r in sampling.sample_linear(keys, F.lit(1.0), extended=True).collect()}
    assert got == {0: 5.0, 1: -inf}
    assert {r.track: r.value for r in sampling.sample_linear(keys, F.lit(-5.0)).collect()} == {0: 0.0, 1: 0.0}
    gate = one(spark, sampling.opacity(F.lit(1.0), F.lit(-inf), F.lit(1.0), F.lit(100.0)), F.exp(N.extended_lerp(F.lit(0.0), F.lit(math.log(9)), F.lit(0.5))))
    assert gate.c0 == 0 and gate.c1 == pytest.approx(3)


def test_export_frame(spark):
    q = lambda *v: Q.quat(*[F.lit(float(x)) for x in v])
    r = one(spark, Q.slerp_export(q(2, 0, 0, 0), q(2, 0, 2, 0), F.lit(0.5)), N.logit(sampling.opacity(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))), N.logit(F.lit(0.0)))
    assert tuple(r.c0) == pytest.approx((math.cos(math.pi / 8), 0, math.sin(math.pi / 8), 0))
    assert r.c1 == pytest.approx(math.log(0.125 / 0.875)) and r.c2 == pytest.approx(math.log(1e-6), abs=1e-4)
    z = one(spark, Q.slerp(q(0, 0, 0, 0), q(1, 0, 0, 0), F.lit(0.4)), Q.slerp_export(q(0, 1, 0, 0), q(0, 0, 0, 0), F.lit(0.4)))
    assert tuple(z.c0) == (1, 0, 0, 0) and tuple(z.c1) == pytest.approx((0, 1, 0, 0))


def test_segment_timeline(spark):
    seg = spark.createDataFrame([(0, "segment_210_240"), (1, "segment_180_210"), (2, "segment_240_259")], "file_index int, name string")
    ordered = sampling.order_segments(seg)
    assert [r.file_index for r in ordered.orderBy("position").collect()] == [1, 0, 2]
    at = spark.createDataFrame([(29.0,), (29.5,), (30.0,), (79.0,), (500.0,), (-3.0,)], "at double")
    got = {r.at: (r.segment, r.local_frame, r.source_frame) for r in sampling.locate(at, ordered).collect()}
    assert got == {29.0: (0, 29, 209), 29.5: (0, 29.5, 209.5), 30.0: (1, 0, 210), 79.0: (2, 19, 259), 500.0: (2, 19, 259), -3.0: (0, 0, 180)}
    assert sampling.gaps(ordered).count() == 0
    broken = sampling.order_segments(spark.createDataFrame([(0, "a_0_30"), (1, "a_31_61")], "file_index int, name string"))
    assert sampling.gaps(broken).count() == 1


def test_exact_boundary_match(spark):
    kinds = "x int, y int, z int, features array<int>"
    prev = spark.createDataFrame([(0, 1, 2, 3, [10, 11]), (1, 1, 2, 3, [20, 21]), (2, 4, 5, 6, [30, 31])], f"prev long, {kinds}")
    cur = spark.createDataFrame([(0, 1, 2, 3, [20, 21]), (1, 1, 2, 3, [10, 11]), (2, 4, 5, 6, [30, 99]), (3, 9, 9, 9, [0, 0])], f"cur long, {kinds}")
    m = boundary.exact_match(prev, cur, ["x", "y", "z"])
    known = spark.createDataFrame([(0, 100), (1, 101), (2, 102)], "prev long, track_id long")
    assert {r.cur: r.track_id for r in boundary.extend_tracks(cur, m, known, 103).collect()} == {0: 101, 1: 100, 2: 102, 3: 103}


def test_near_boundary_match(spark):
    prev = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0)], "prev long, x double, dc double")
    cur = spark.createDataFrame([(0, 0.01, 0.0), (1, 0.02, 0.0), (2, 1.01, 0.0)], "cur long, c_x double, c_dc double")
    gate = F.abs(F.col("dc") - F.col("c_dc")) <= 0.1
    assert {r.cur: r.prev for r in boundary.near_match(prev, cur, ["x"], 0.1, gate).collect()} == {0: 0, 2: 1}
    assert boundary.near_match(prev, cur.withColumn("c_dc", F.lit(1.0)), ["x"], 0.1, gate).count() == 0


def test_regions(spark):
    assert selection.normalize_rect(20, 30, 10, 5) == (10, 5, 20, 30) and selection.normalize_rect(10, 10, 10, 10, 6) == (7, 7, 13, 13)
    c = lambda *v: [F.lit(float(x)) for x in v]
    tri = [(0, 0), (10, 0), (5, 10)]
    r = one(
        spark, selection.in_rect(*c(2, 9), (2, 3, 8, 9)), selection.in_rect(*c(8.1, 9), (2, 3, 8, 9)), selection.in_brush(*c(15, 7), [(5, 5), (25, 5)], 4), selection.in_brush(*c(15, 10), [(5, 5), (25, 5)], 4),
        selection.in_brush(*c(148, 100), [(100, 100)], 48), selection.in_brush(*c(148.01, 100), [(100, 100)], 48), selection.in_polygon(*c(5, 5), tri), selection.in_polygon(*c(9, 9), tri), selection.in_polygon(*c(5, 10), tri),
        *[selection.in_cylinder(*c(*p), 1, -2, 2, 3, 0.25) for p in ((3, 3, -2), (1, -0.25, -2), (3.01, 1, -2), (1, -0.251, -2), (float("nan"), 1, -2))],
    )
    assert list(r) == [True, False, True, False, True, False, True, False, True, True, True, False, False, False]


def test_edits(spark):
    edits = spark.createDataFrame([(0, i, i in (1, 5), i in (0, 3)) for i in range(6)], "segment_id int, stable_id long, deleted boolean, selected boolean")
    ids = lambda df: sorted(r.stable_id for r in df.where("selected").collect())
    assert ids(selection.invert(edits)) == [2, 4]
    pick = lambda *v: spark.createDataFrame([(0, i) for i in v], "segment_id int, stable_id long")
    chosen = selection.select(edits, pick(2, 3), "replace")
    assert ids(chosen) == [2, 3] and ids(selection.select(chosen, pick(3, 4), "toggle")) == [2, 4]
    assert ids(selection.select(chosen, pick(4, 4), "toggle")) == [2, 3] and ids(selection.select(chosen, pick(0, 1), "add")) == [0, 2, 3] and ids(selection.select(chosen, pick(2), "remove")) == [3]
    gone = selection.delete_selected(chosen)
    assert gone.where("deleted").count() == 4 and gone.where("newly").count() == 2 and ids(gone) == []


def test_histogram_and_bounds(spark):
    v = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, float("nan"))], "v double")
    h = stats.histogram(v, "v").collect()
    assert len(h) == 48 and sum(r["count"] for r in h) == 3 and h[-1]["count"] == 1
    assert sum(r["count"] for r in stats.histogram(v.where("v = 1"), "v").collect()) == 1
    empty = stats.histogram(v.where("false"), "v").collect()
    assert len(empty) == 48 and not any(r["count"] for r in empty)
    pts = spark.createDataFrame([(0.0, 1.0, 2.0), (float("inf"), 0.0, 0.0)], "x double, y double, z double")
    b = stats.bounds(pts).first()
    assert b.skipped == 1 and b.min_x == pytest.approx(-1e-4) and b.max_z == pytest.approx(2.0001)
    with pytest.raises(Exception, match="finite"):
        stats.bounds(pts, strict=True).collect()


def test_envelope(spark):
    cube = spark.createDataFrame([(float(x), float(y), float(z)) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)], "x double, y double, z double")
    s = [r.support for r in stats.support(cube).orderBy("direction").collect()]
    vertices, triangles, edges = stats.envelope(s)
    assert len(s) == 26 and 1 < max(v[0] for v in vertices) < 1.01
    for a, b, c in triangles:  # all face outwards
        p, q, o = (np.array(vertices[i]) for i in (a, b, c))
        assert np.cross(q - p, o - p) @ (p + q + o) > 0
    far = [x + 1000 * d[0] for x, d in zip(s, stats.DIRECTIONS)]
    assert max(abs(max(v[0] for v in stats.envelope(far)[0]) - 1000 - max(v[0] for v in vertices)), 0) < 1e-9  # padding does not grow with the distance from the origin


def test_health(spark):
    nan = float("nan")
    rows = [(0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 100.0, 100.0, 0.0, 1.0), (nan, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, nan, 0.0, 0.0, -1.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double, qw double, qx double, qy double, qz double, scale double, opacity double, mu double, w double")
    got = {r.code: r["count"] for r in stats.health(df).collect()}
    assert got == {"nonfinite-position": 1, "nonfinite-rotation": 0, "nonfinite-scale": 1, "nonfinite-opacity": 0, "quaternion-length": 2, "scale-range": 2, "opacity-range": 1, "lifetime": 1}


def test_encodings(spark):
    t, v = np.arange(8.0), np.array([0, 1, 2, 3, 3, 3, 3, 9.0])
    assert temporal.fewest_knots(t, v, 0.0) == [0, 3, 6, 7] and temporal.simplify(t, np.ones(8), 0.0) == [0]
    assert set(temporal.simplify(t, v, 0.0)) >= {0, 7}
    rows = spark.createDataFrame([(0, k, float(x)) for k, x in enumerate((0.0, 0.4, 0.9, 1.3, 5.0))], "track long, k int, v double")
    assert [r.k for r in temporal.thresholded_updates(rows, "v", 0.8).orderBy("k").collect()] == [0, 2, 4]
    assert all(abs(r.decoded - v) <= 0.05 + 1e-12 for r, v in zip(temporal.closed_loop(rows, "v", 0.1).orderBy("k").collect(), (0.0, 0.4, 0.9, 1.3, 5.0)))


def test_fits_recover_a_motion(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    m = fits.matrix((0.9, 0.1, -0.3, 0.2))
    y = 1.7 * x @ m.T + [1, 2, 3]
    pairs = spark.createDataFrame([(i % 2, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))], "block long, x double, y double, z double, u double, v double, w double")
    for r in fits.fit_blocks(pairs, "block", "similarity").collect():
        assert r.rmse < 1e-5 and r.m00 == pytest.approx(1.7 * m[0, 0]) and (r.tx, r.ty, r.tz) == pytest.approx((1, 2, 3))
    d = rng.normal(size=(5, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    for band in (1, 2, 3):
        rot = fits.sh_rotation((0.9, 0.1, -0.3, 0.2), band)
        c = rng.normal(size=2 * band + 1)
        assert fits._basis(d, band) @ (rot @ c) == pytest.approx(fits._basis(d @ m, band) @ c)


def test_dense_ids(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("code"))
    got = layout.dense_ids(rows, ["code"]).collect()
    assert all(r.code == r.dense_id for r in got)


def test_ranks_of_skewed_values(spark):
    """One value in half the rows and one far outlier: ranks stay right and no range holds the rest."""
    rows = spark.range(4000).select(F.when(F.col("id") == 7, 1e300).when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("x"), "id")
    values = sorted([1e300 if i == 7 else 5.0 if i % 2 == 0 else float(i) for i in range(4000)])
    got = {r.p: r.value for r in stats.nearest_rank(rows, "x", (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    assert got == {p: values[int(p * 3999 + 0.5)] for p in got} and len(got) == 5
    assert stats.quantiles(rows, "x", [0.1, 0.7]) == pytest.approx(np.quantile(values, [0.1, 0.7]).tolist())
    assert stats.quantiles(rows.where("false"), "x", [0.5]) is None
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else ranges this small become one
    parts = layout.by_ranges(rows, ["x", "id"]).groupBy("_part").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in parts) < 4000 * 0.6
    tiers = layout.tiers(rows.withColumnRenamed("id", "t"), "x", "t", (0.1, 0.5)).groupBy("tier").count().collect()
    assert {r.tier: r["count"] for r in tiers} == {0: 400, 1: 1600, 2: 2000}
