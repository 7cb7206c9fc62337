"""Images, residual codebooks, knots, chains, offline samples, reports, holes and manifests against plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointflux import plans
from pointflux.functions import quaternion as Q  # noqa: F401
from pointflux.operators import field, images, mesh, residual, sampling, temporal
from pointflux.sinks import report
from pointflux.sources import container

SF = "/root/testdata/sf0.001"


def plain_refined(source, front):
    """Pixel by pixel."""
    h, w = source.shape
    upper = lambda v: sorted(v)[len(v) // 2]

    def around(v, y, x):
        cells = [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
        return [int(v[a, b]) for a, b in cells if 0 <= a < h and 0 <= b < w and v[a, b] > 0]

    now = source.copy()
    for y in range(h):
        for x in range(w):
            near = around(source, y, x)
            if source[y, x] and (len(near) <= 1 or len(near) >= 4 and abs(source[y, x] - upper(near)) > max(3, upper(near) * 0.12)):
                now[y, x] = 0
    seen = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            if now[y, x] and not seen[y, x]:
                patch, at = [(y, x)], 0
                seen[y, x] = True
                while at < len(patch):
                    a, b = patch[at]
                    at += 1
                    for c in range(max(0, a - 1), min(h, a + 2)):
                        for d in range(max(0, b - 1), min(w, b + 2)):
                            if now[c, d] and not seen[c, d] and abs(int(now[c, d]) - int(now[a, b])) <= max(3, min(now[a, b], now[c, d]) * 0.16):
                                seen[c, d] = True
                                patch.append((c, d))
                if len(patch) < 7:
                    for a, b in patch:
                        now[a, b] = 0
                        seen[a, b] = True
    for _ in range(3):
        new = now.copy()
        for y in range(h):
            for x in range(w):
                if now[y, x] or not front[y, x]:
                    continue
                near = around(now, y, x)
                if len(near) >= 3 and max(near) - min(near) <= max(4, upper(near) * 0.16):
                    new[y, x] = int(upper(near) + 0.5)
                if not new[y, x]:
                    found = []
                    for dy, dx in ((0, 1), (1, 0)):
                        ends = []
                        for sign in (-1, 1):
                            line = [(y + sign * dy * d, x + sign * dx * d) for d in range(1, 5)]
                            ends.append(next((int(now[a, b]) for a, b in line if 0 <= a < h and 0 <= b < w and now[a, b]), 0))
                        middle = sum(ends) / 2
                        if min(ends) > 0 and abs(ends[0] - ends[1]) <= max(3, middle * 0.14):
                            found.append(middle)
                    if found:
                        new[y, x] = int(np.floor(upper(found) + 0.5))
        now = new
    return now


def test_refined_disparities():
    rng = np.random.default_rng(0)
    for shape in ((9, 14), (1, 5), (5, 1), (24, 20), (3, 3)):
        base = np.add.outer(np.arange(shape[0]) * 3, np.arange(shape[1]) * 2) + 60
        noisy = np.where(rng.random(shape) < 0.25, 0, base + (rng.random(shape) < 0.1) * 90)
        front = rng.random(shape) < 0.8
        assert (images.refined(noisy, front) == plain_refined(noisy, front)).all()


def test_refined_query(spark):
    got = {r.image: np.array(r.disparity).reshape(8, 8) for r in plans.QUERIES["F717_refined_disparities"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        e = np.array(r.embedding, float).reshape(8, 8)
        assert (got[r.vec_id] == plain_refined(np.where(e < -0.12, 0, np.floor(100 + 60 * e)).astype(int), e < 0.2)).all()


def test_residual_levels(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (150, 4)) for c in rng.normal(0, 3, (12, 4))])
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, part int")
    one = {r.id: r for r in residual.tree_levels(rows, "v", ["id"], 1).collect()}
    two = residual.tree_levels(rows, "v", ["id"], 2).collect()
    assert len(two) == len(x) and np.mean([r.error for r in two]) < np.mean([r.error for r in one.values()]) < 0.2
    for r in two:
        assert abs(np.linalg.norm(x[r.id] - np.array(r.decoded)) - r.error) < 1e-9 and len(r.labels) == 2 and all(0 <= c < 256 for c in r.labels)
    tree = residual.train_tree(residual.sample(rows, "v"))
    for v, label in zip(x[::97], tree.label(x[::97])):
        top = ((tree.coarse - v) ** 2).sum(1).argmin()
        assert label == top * 16 + ((tree.fine[top * 16 : top * 16 + 16] - v) ** 2).sum(1).argmin()
    shared = residual.shared_levels(rows, "v", ["id"], "part", 32, 3).collect()
    assert len(shared) == len(x) and np.mean([r.error for r in shared]) < 0.3
    again = residual.shared_levels(rows, "v", ["id"], "part", 32, 3).collect()
    assert sorted(map(str, shared)) == sorted(map(str, again))
    zero = residual.encode(rows.limit(1).select("id", F.array(*[F.lit(0.0)] * 4).alias("v")), "v", [residual.train_flat(x, 16, 3, keep_zero=True)], ["id"]).first()
    assert zero.labels == [0] and zero.error == 0
    assert residual.encode(rows.where("false"), "v", [tree], ["id"]).count() == 0


def test_curve_bank(spark):
    rng = np.random.default_rng(2)
    curves = rng.normal(0, 1, (400, 12))
    rows = spark.createDataFrame([(i, c.tolist(), float(i)) for i, c in enumerate(curves)], "id long, curve array<double>, weight double")
    got = residual.curve_bank(rows, "curve", "weight", ["id"], clusters=32, levels=2, share=0.1, sparse_clusters=16).collect()
    assert len(got) == 400
    for r in got:
        moved = (curves[r.id].reshape(4, 3)[1:] - curves[r.id][:3]).ravel()
        assert abs(np.linalg.norm(moved - np.array(r.decoded)) - r.error) < 1e-9 and len(r.labels) == 3
        assert r.labels[2] == 0 or r.id >= 360


def test_knots_of_points():
    t, line = np.arange(6.0), np.outer(np.arange(6.0), [1.0, 2.0, 0.0])
    assert temporal.fewest_knots(t, line, 0.01) == [0, 5] and temporal.fewest_knots(t, line * 0, 0.01) == [0]
    bent = line.copy()
    bent[3] += [0, 0, 5]
    assert temporal.fewest_knots(t, bent, 0.01) == [0, 2, 3, 4, 5] and temporal.fewest_knots(t, bent, 6.0) == [0, 5]
    assert temporal.fewest_knots(t, bent, 6.0, hard=1.0) == list(range(6))


def test_so3_codes_decode(spark):
    """The decoded chain follows each rotation within the gate."""
    rows = {r.vec_id: np.array(r.embedding[:4], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    mul = lambda a, b: np.array([a[0] * b[0] - a[1:] @ b[1:], *(a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:]))])
    at = {}
    for r in plans.QUERIES["F606_so3_chain"](spark, SF).orderBy("k").collect():
        v = np.array([r.cx, r.cy, r.cz]) * np.radians(0.1) / 2
        a = np.linalg.norm(v)
        step = np.array([np.cos(a / 2), *(v * (np.sin(a / 2) / a if a > 1e-12 else 0.5))])
        at[r.track] = mul(at.get(r.track, np.array([1.0, 0, 0, 0])), step)
        want = rows[r.k] / np.linalg.norm(rows[r.k])
        assert np.degrees(2 * np.arccos(min(1.0, abs(at[r.track] @ want)))) < 0.1 and r.error_degrees < 0.1


def test_tree_codebook_descends_to_the_nearer_side(spark):
    from pointflux.operators import codebooks

    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (500, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    tree = codebooks.tree_codebook(rows, "v", 4, 5)
    for r in rows.select("id", codebooks.descend(F.col("v"), tree, 4).alias("leaf")).collect():
        node = 1
        for _ in range(4):
            left, right = (np.array(c) for c in tree[node])
            node = 2 * node + int(((x[r.id] - right) ** 2).sum() < ((x[r.id] - left) ** 2).sum())
        assert r.leaf == node


def test_offline_sample_raises_and_propagates(spark):
    low = float("-inf")
    keys = spark.createDataFrame([(0, 0, 1.0), (0, 10, low), (0, 20, 3.0), (1, 5, 4.0)], "track int, frame int, o double")
    at = lambda f: {r.track: r.o for r in sampling.offline_sample(keys, f, 31, ["o"]).collect()}
    assert at(0.0) == {0: 1.0, 1: 4.0} and at(5.0) == {0: low, 1: 4.0} and at(15.0)[0] == low and at(20.0)[0] == 3.0 and at(30.0) == {0: 3.0, 1: 4.0}
    assert at(10.0)[0] == low
    for f in (-0.1, 30.5):
        with pytest.raises(ValueError):
            sampling.offline_sample(keys, f, 31, ["o"])


def test_reports(spark, tmp_path):
    table = spark.createDataFrame([("a,b", None, 1.5), ('q"', "<x>|", 2.0)], "k string, t string, v double")
    for kind, want in (("csv", ['"a,b",,1.5', '"q""",<x>|,2.0']), ("markdown", ["| a,b |  | 1.5 |", '| q" | <x>\\| | 2.0 |']), ("html", ["<tr><td>a,b</td><td></td><td>1.5</td></tr>", '<tr><td>q"</td><td>&lt;x&gt;|</td><td>2.0</td></tr>'])):
        report.write(table, str(tmp_path / kind), kind, "Audit")
        assert sorted(r.value for r in spark.read.text(str(tmp_path / kind)).collect()) == sorted(want)
        assert "k" in (tmp_path / kind / "_head").read_text()
    with pytest.raises(ValueError):
        report.lines(table, "pdf")


def test_holes(spark):
    """A sheet with a square hole, a hole too wide, and one whose corner meets another."""
    def quad(x, y):
        return [(100 * y + x, 100 * y + x + 1, 100 * (y + 1) + x), (100 * y + x + 1, 100 * (y + 1) + x + 1, 100 * (y + 1) + x)]

    gone = {(3, 3), (8, 3), (8, 4), (9, 3), (9, 4), (4, 9), (5, 10)}
    triangles = [t for y in range(14) for x in range(14) if (x, y) not in gone for t in quad(x, y)]
    vertices = spark.createDataFrame([(100 * y + x, float(x), float(y), 0.0) for y in range(15) for x in range(15)], "v long, x double, y double, z double")
    made, centres = mesh.fill_holes(spark.createDataFrame(triangles, "a long, b long, c long"), vertices, 2.0)
    assert {tuple(r) for r in centres.collect()} == {(-1 - 303, 3.5, 3.5, 0.0)}
    assert {(r.a, r.b, r.c) for r in made.collect()} == {(303, 304, -304), (304, 404, -304), (404, 403, -304), (403, 303, -304)}
    assert mesh.fill_holes(spark.createDataFrame([], "a long, b long, c long"), vertices, 2.0)[0].count() == 0


def test_manifest_of_nothing(spark):
    rows = spark.createDataFrame([("{}",), ("no json",), (None,), (json.dumps({"format": "4CGS"}),)], "m string")
    for r in rows.select("m", container.manifest_problems(F.col("m")).alias("p")).collect():
        assert "version" in r.p and "no scale" in r.p and ("format" in r.p) == (r.m is None or "4CGS" not in r.m)


def test_manifest_is_parsed_once(spark):
    """Once for whether it is JSON and once for its fields, not at each rule; a text that breaks off has no fields at all."""
    good = {"format": "4CGS", "version": 2, "codecName": container.BUNDLE, "slotCount": 1, "uniqueFrameCount": 1, "streams": [{"name": "a", "compression": "raw", "rawBytes": 1, "storedBytes": 1, "rawSha256": "0" * 64, "storedSha256": "0" * 64}]}
    rows = spark.createDataFrame([(0, json.dumps(good)), (1, json.dumps(good)[:-20]), (2, json.dumps(good | {"version": "two"}))], "i int, m string")
    out = rows.select("i", container.manifest_problems(F.col("m")).alias("p"))
    segments = ["segment counts", "segment frames", "segment timing", "segments"]
    got = {r.i: r.p for r in out.collect()}
    assert got[0] == segments and got[2] == [*segments, "version"] and {"format", "streams", "version"} < set(got[1])
    for df in (out, plans.QUERIES["F720_json_manifest"](spark, SF)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 2


def test_surface_is_closed_and_faces_outwards(spark):
    """One ball, two that touch, and one far away: every edge has two triangles, volume is positive, pieces have no holes."""
    balls = [(0, 0.2, 0.1, 0.3), (1, 20.0, 0.0, 0.0), (2, 23.0, 0.0, 0.0)]
    points = spark.createDataFrame([(i, x, y, z, 2.0, 2.0, 2.0, 1.0, 0.0, 0.0, 0.0, 1.0) for i, x, y, z in balls], "stable_id long, x double, y double, z double, s0 double, s1 double, s2 double, qw double, qx double, qy double, qz double, alpha double")
    vertices, triangles = field.surface(field.splat(points, 0.5), 0.5, 0.5)
    vertices, triangles = vertices.cache(), triangles.cache()
    edges = mesh.triangle_edges(triangles).groupBy("u", "v").count().collect()
    assert {r["count"] for r in edges} == {2}
    assert vertices.count() - len(edges) + triangles.count() == 2 * 2  # two closed pieces
    one = triangles.join(vertices.where("x < 10").select("v"), triangles.a == vertices.v).select("t", "a", "b", "c")
    radius = 2.0 * (2 * np.log(2)) ** 0.5  # where exp(-d^2 / 2) is a half
    volume = mesh.signed_volume(one, vertices).first().volume
    assert abs(volume / (4 / 3 * np.pi * radius**3) - 1) < 0.05
    assert {r.winner for r in vertices.where("x < 10").collect()} == {0} and {r.winner for r in vertices.where("x > 10").collect()} == {1, 2}
