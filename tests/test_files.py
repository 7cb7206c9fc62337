import numpy as np
import pytest
from pyspark.sql import functions as F

from pointflux.operators import streams
from pointflux.sinks import ply as sink
from pointflux.sources import container, fourgs, mesh, ply


def test_ply_round_trip(spark, tmp_path):
    points = spark.range(20_000).select(F.col("id").alias("stable_id"), (F.col("id") * 0.5).cast("float").alias("x"), (F.col("id") % 7).cast("short").alias("flag"), F.lit(-1.25).alias("v"))
    path = str(tmp_path / "clip_0_30.ply")
    assert sink.write_file(points, path, ["x", "flag", "v"], "stable_id", {"total_frames": "31"}) == 20_000
    ply.register(spark)
    back = spark.read.format("pointply").option("rows", 3000).load(path)
    assert back.select("stable_id", "x", "flag", "v").exceptAll(points).count() == 0 and back.count() == 20_000
    pruned = spark.read.format("pointply").option("columns", "x").load(path)
    assert pruned.columns == ["stable_id", "source_element", "x"]
    with open(path, "ab") as f:
        f.write(b"\0")
    with pytest.raises(Exception, match="expected"):
        spark.read.format("pointply").load(path).count()
    assert ply.frame_range("a_1_2_segment_210-240.ply") == (210, 240) and ply.frame_range("x.ply") is None


def test_ply_ascii_and_header_errors(spark, tmp_path):
    path = tmp_path / "a.ply"
    path.write_bytes(b"ply\nformat ascii 1.0\ncomment total_frames 3\nelement vertex 2\nproperty float x\nproperty uchar c\nend_header\n1.5 7\n-2 255\n")
    ply.register(spark)
    rows = spark.read.format("pointply").load(str(path)).orderBy("stable_id").collect()
    assert [(r.x, r.c) for r in rows] == [(1.5, 7), (-2.0, 255)]
    with pytest.raises(ValueError, match="twice"):
        ply.parse_header(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float x\nend_header\n")
    with pytest.raises(ValueError):
        ply.parse_header(b"nothing")
    assert ply.banks(["xyz_bank_0_0", "xyz_bank_1_2", "opacity_bank_3"]) == {"xyz": 2, "opacity": 4}


def test_container(spark, tmp_path):
    for codec in ("raw", "deflate", "shuffle16-deflate"):
        data = container.pack({"version": 2}, {"a": b"abc" * 100, "b": b"", "c": bytes(range(251))}, codec)
        (tmp_path / f"{codec}.4c").write_bytes(data)
        renamed = container.rewrite_manifest(data, {"version": 3})
        assert container.parse(renamed)[0]["version"] == 3
    got = container.read_streams(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(got) == 9 and all(bytes(r.data) == {"a": b"abc" * 100, "b": b"", "c": bytes(range(251))}[r.stream] for r in got)
    with pytest.raises(ValueError):
        container.parse(data[:-1])


def test_bundle_is_lossless_and_detects_damage(spark):
    rows = [("a", b"xyz" * 1001), ("b", b""), ("c", bytes(range(256)))]
    chunks = streams.bundle(spark.createDataFrame(rows, "name string, data binary"), chunk=500)
    assert {r.name: bytes(r.data) for r in streams.unbundle(chunks).collect()} == dict(rows)
    with pytest.raises(Exception, match="damaged"):
        streams.unbundle(chunks.withColumn("stored", F.lit(b"zz"))).collect()


def test_rans():
    rng = np.random.default_rng(0)
    data = bytes(rng.choice(9, 5000, p=[0.5, 0.2, 0.1, 0.05, 0.05, 0.04, 0.03, 0.02, 0.01]).astype(np.uint8))
    freqs = streams.normalized_frequencies(np.bincount(np.frombuffer(data, np.uint8), minlength=256))
    code = streams.rans_encode(data, freqs)
    assert sum(freqs) == 4096 and streams.rans_decode(code, freqs, len(data)) == data and len(code) < 2000


def test_catalog_check(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("y", 2), ("z", 3)], "id string, n int")
    b = spark.createDataFrame([("x", 1), ("y", 9), ("w", 1)], "id string, n int")
    got = {(r.id, r.problem) for r in container.catalog_check(a, b, ["n"]).collect()}
    assert got == {("y", "differs: n"), ("z", "no file"), ("w", "not listed"), ("y", "listed twice")}


def _motion_file(spark, path, version=3, threshold=0.0, rows=((1, 2, 3), (4, 5, 6)), **changes):
    names = list(fourgs.REQUIRED)
    value = {"opacity": 0.0, "scale_0": -2.0, "scale_1": -3.0, "scale_2": -4.0, "rot_0": 1.0, "velocity_per_frame_0": 2.0, "frame_center": 1.0, "sigma_frames": 1.0}
    data = [(i, *(float(dict(zip("xyz", r)).get(n, changes.get(n, value.get(n, 0.0)))) for n in names)) for i, r in enumerate(rows)]
    points = spark.createDataFrame(data, "stable_id long, " + ", ".join(f"{n} float" for n in names))
    trailer = fourgs.footer(names, len(rows), 0, 2, threshold) if version == 3 else b""
    sink.write_file(points, path, names, "stable_id", {fourgs.TITLE: f"version {version}", "normalized_time_frames": "0 2 3"}, trailer=trailer)


def test_linear_motion_files(spark, tmp_path):
    for version in (2, 3):
        path = str(tmp_path / f"v{version}.4gs")
        _motion_file(spark, path, version)
        clip, points = fourgs.read_points(spark, path)
        assert (clip.version, clip.frames, clip.bands, clip.frame_rate) == (version, 3, 0, 30.0)
        first = fourgs.lifetimes(points, clip).where("stable_id = 0").first()
        assert [first[f"xyz_bank_{k}_0"] for k in (0, 1)] == [-1, 3] and (first.lifetime_mu, first.lifetime_w) == (1, 1)
        logits = {r.frame: r.logit for r in fourgs.visible_logits(points, clip).where("stable_id = 0").collect()}
        assert logits[1] == 0 and abs(logits[0] + 1.48988) < 1e-5 and abs(logits[2] + 1.48988) < 1e-5
    data = open(path, "rb").read()
    for k, damage in enumerate((data[:-1], data[:-60] + b"x" + data[-59:], data.replace(b"version 3", b"version 4"), data.replace(b"property float rot_3", b"property float rot_9"))):
        bad = tmp_path / f"bad{k}.4gs"
        bad.write_bytes(damage)
        with pytest.raises(ValueError):
            fourgs.read_clip(str(bad))
    _motion_file(spark, str(tmp_path / "t.4gs"), threshold=0.4)
    clip, points = fourgs.read_points(spark, str(tmp_path / "t.4gs"))
    assert {r.frame: r.logit for r in fourgs.visible_logits(points, clip).where("stable_id = 1").collect()} == {0: -65504.0, 1: 0.0, 2: -65504.0}
    _motion_file(spark, str(tmp_path / "n.4gs"), sigma_frames=-1.0)
    with pytest.raises(Exception, match="sigma_frames"):
        fourgs.read_points(spark, str(tmp_path / "n.4gs"))[1].collect()


def test_meshes(spark, tmp_path):
    head = b"ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty float r\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    path = tmp_path / "m.ply"
    path.write_bytes(head + b"0 0 0 7\n1 0 0 7\n1 1 0 7\n0 1 0 300\n4 0 1 2 3\n3 0 2 3\n")
    v, t = mesh.read_mesh(spark, str(path))
    assert [(r.a, r.b, r.c) for r in t.orderBy("t").collect()] == [(0, 1, 2), (0, 2, 3), (0, 2, 3)]
    assert {(r.v, r.red, r.green, r.nx) for r in v.collect()} >= {(0, 7, 255, 0.0), (3, 255, 255, 0.0)}
    path.write_bytes(head + b"0 0 0 7\n1 0 0 7\n1 1 0 7\n0 1 0 9\n4 0 1 2 4\n3 0 2 3\n")
    with pytest.raises(Exception, match="not there"):
        mesh.read_mesh(spark, str(path))[1].collect()
    big = tmp_path / "b.ply"
    big.write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 3\nproperty double x\nproperty double y\nproperty double z\nelement face 1\nproperty list uchar uint vertex_indices\nproperty uchar flag\nend_header\n" + np.arange(9, dtype=">f8").tobytes() + bytes([3]) + np.array([2, 1, 0], ">u4").tobytes() + b"\1")
    v, t = mesh.read_mesh(spark, str(big))
    assert [tuple(r) for r in t.collect()] == [(0, 2, 1, 0)] and [r.x for r in v.orderBy("v").collect()] == [0, 3, 6]
    out = str(tmp_path / "o.ply")
    assert mesh.write_mesh(v, t, out) == (3, 1)
    again, tri = mesh.read_mesh(spark, out)
    assert again.exceptAll(v).count() == 0 and tri.exceptAll(t).count() == 0
    assert len(open(out, "rb").read()) == ply.read_header(out).size + 3 * 28 + 13
    for bad in (v.where("v > 0"), v.where("v < 0")):
        with pytest.raises(ValueError):
            mesh.write_mesh(bad, t, out)


def test_source_compaction_copies_bytes(spark, tmp_path):
    path, out = tmp_path / "s.raw4d", str(tmp_path / "c.raw4d")
    rng = np.random.default_rng(0)
    head = b"ply\nformat binary_little_endian 1.0\ncomment total_frames 31\nelement vertex 700\nproperty float x\nproperty uchar c\nelement vertex_static 9\nproperty double x\nend_header\n"
    body, static = rng.bytes(700 * 5), rng.bytes(9 * 8)
    path.write_bytes(head + body + static)
    gone = [0, 5, 699, 700, 708]
    kept = sink.compact_source(spark, str(path), spark.createDataFrame([(g,) for g in [*gone, 5, 9999]], "stable_id long"), out, rows=256)
    want = head.replace(b"vertex 700", b"vertex 697").replace(b"static 9", b"static 7")
    want += b"".join(body[5 * i : 5 * i + 5] for i in range(700) if i not in gone) + b"".join(static[8 * i : 8 * i + 8] for i in range(9) if i + 700 not in gone)
    assert kept == 704 and open(out, "rb").read() == want
    with pytest.raises(ValueError, match="nothing"):
        sink.compact_source(spark, str(path), spark.range(709).withColumnRenamed("id", "stable_id"), out)


def test_integers_that_do_not_fit(spark, tmp_path):
    for bad in (2**32, -1, None):
        with pytest.raises(Exception, match="fit|null"):
            sink.write_file(spark.createDataFrame([(0, bad)], "i long, v long"), str(tmp_path / "x.ply"), ["v"], "i")
