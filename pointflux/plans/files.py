"""Files written from the driver's tables and read again (F001 to F027)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import numeric as N
from ..operators.streams import bundle, unbundle
from ..sinks import ply as sink
from ..sources import container, fourgs, mesh, ply, registry
from ..storage import new_path
from .base import keys, points, query, read
from .sampling import r

BANKS = [f"xyz_bank_{k}_{i}" for k in (0, 1) for i in range(3)]
COLUMNS = ["id", *BANKS, "opacity_bank_0", "lifetime_mu", "lifetime_w", "note"]
KINDS = ["u4", *["f4"] * 9, "f8"]

#: What the clip holds, in SQL: single precision, records by id.
CLIP = """MORE clip AS (SELECT row_number() OVER (ORDER BY stable_id) - 1 AS pos, stable_id AS id, x::FLOAT::DOUBLE AS x0, y::FLOAT::DOUBLE AS y0, z::FLOAT::DOUBLE AS z0,
  (x + 1.5)::FLOAT::DOUBLE AS x1, (y * 0.5)::FLOAT::DOUBLE AS y1, (z - 2)::FLOAT::DOUBLE AS z1, opacity::FLOAT::DOUBLE AS o, mu::FLOAT::DOUBLE AS mu, w::FLOAT::DOUBLE AS w, deleted FROM points) """


def _clip(spark, sf):  # noqa: ANN001, ANN202
    """The points as a clip of two keys in a file; returns its path."""
    f32 = lambda c: c.cast("float")
    at = {"xyz_bank_0_0": F.col("x"), "xyz_bank_0_1": F.col("y"), "xyz_bank_0_2": F.col("z"), "xyz_bank_1_0": F.col("x") + 1.5, "xyz_bank_1_1": F.col("y") * 0.5, "xyz_bank_1_2": F.col("z") - 2}
    rows = points(spark, sf).select(
        F.col("stable_id").alias("id"), *[f32(c).alias(n) for n, c in at.items()],
        f32(F.col("opacity")).alias("opacity_bank_0"), f32(F.col("mu")).alias("lifetime_mu"), f32(F.col("w")).alias("lifetime_w"), F.lit(0.5).alias("note"),
    )
    path = new_path(spark, "clip") + ".raw4d"
    sink.write_file(rows, path, COLUMNS, "id", {"total_frames": "31", "xyz_stride": "30"})
    return path


def _load(spark, path, **options):  # noqa: ANN001, ANN003, ANN202
    ply.register(spark)
    return spark.read.format("pointply").options(**options).load(path)


_d = lambda c, n: F.col(c).cast("double").alias(n)


@query("F001_header_scan", f"SELECT 'vertex' AS element, p.i AS at, p.n AS property, p.t AS type, (SELECT count(*) FROM orders) AS records FROM (VALUES {', '.join(f'({i}, {n!r}, {t!r})' for i, (n, t) in enumerate(zip(COLUMNS, KINDS)))}) p(i, n, t)")
def f001(spark, sf):  # noqa: ANN001, ANN201
    header = ply.read_header(_clip(spark, sf))
    rows = [(e.name, i, n, t, e.count) for e in header.elements for i, (n, t) in enumerate(e.properties)]
    return spark.createDataFrame(rows, "element string, at int, property string, type string, records long")


@query("F002_chunked_scan", CLIP + "SELECT pos AS stable_id, id, x0, y1, z1, o, mu, w FROM clip", "points")
def f002(spark, sf):  # noqa: ANN001, ANN201
    rows = _load(spark, _clip(spark, sf), rows="700")
    return rows.select("stable_id", "id", _d("xyz_bank_0_0", "x0"), _d("xyz_bank_1_1", "y1"), _d("xyz_bank_1_2", "z1"), _d("opacity_bank_0", "o"), _d("lifetime_mu", "mu"), _d("lifetime_w", "w"))


@query("F003_sniff", "SELECT * FROM (VALUES ('clip', 'RAW4D', true), ('points', 'PLY', false), ('motion', '4GS', false), ('streams', '4CGS', false), ('other', NULL, false)) t(file, format, temporal)")
def f003(spark, sf):  # noqa: ANN001, ANN201
    from ..sources.files import open_output

    path = {n: new_path(spark, n) for n in ("streams", "other")}
    path |= {"clip": _clip(spark, sf), "points": _static(spark, sf), "motion": _motion(spark, sf)}
    for name, data in (("streams", container.pack({"version": 1}, {"a": b"x"})), ("other", b"no such format")):
        with open_output(path[name]) as f:
            f.write(data)
    kinds = {n: registry.sniff(p) for n, p in path.items()}
    rows = [(n, k, k in ("RAW4D", "PLY", "4GS") and ply.is_temporal(ply.read_header(path[n]))) for n, k in kinds.items()]
    return spark.createDataFrame(rows, "file string, format string, temporal boolean")


@query("F004_required_columns", CLIP + "SELECT pos AS stable_id, x0, y0, z0, x1, y1, z1, o, mu, w FROM clip", "points")
def f004(spark, sf):  # noqa: ANN001, ANN201
    """Only what sampling needs is read: neither the id nor the note."""
    path = _clip(spark, sf)
    need = ply.required_columns([n for e in ply.read_header(path).elements for n, _ in e.properties])
    names = dict(zip([*BANKS, "opacity_bank_0", "lifetime_mu", "lifetime_w"], ("x0", "y0", "z0", "x1", "y1", "z1", "o", "mu", "w"), strict=True))
    rows = _load(spark, path, columns=",".join(need)).drop("source_element")
    return rows.select("stable_id", *[_d(c, names.get(c, c)) for c in rows.columns if c != "stable_id"])


@query("F006_half_records", """MORE b AS (SELECT DISTINCT v16 AS bits FROM keys), p AS (SELECT bits, CASE WHEN bits >= 32768 THEN -1.0 ELSE 1.0 END AS s, (bits >> 10) & 31 AS e, (bits & 1023)::DOUBLE AS m FROM b)
SELECT bits, e = 31 AS special, CASE WHEN e = 31 THEN 0.0 WHEN e = 0 THEN s * m * pow(2.0, -24) ELSE s * (1024 + m) * pow(2.0, e - 25) END::DOUBLE + 0.0 AS value FROM p""", "keys")
def f006(spark, sf):  # noqa: ANN001, ANN201
    """Half-precision records, written and split into columns again."""
    rows = keys(spark, sf).select(F.col("v16").cast("long").alias("bits")).distinct().withColumn("value", B.half_to_double(F.col("bits")).cast("float"))
    path = new_path(spark, "halves") + ".raw4d"
    sink.write_file(rows, path, ["value"], "bits", half=["value"])
    back = _load(spark, path).select("stable_id", F.col("value").cast("double").alias("value"))
    # Records lie in the order of their bits, so the n-th record belongs to the n-th pattern.
    ids = rows.select("bits", (F.row_number().over(Window.orderBy("bits")) - 1).cast("long").alias("stable_id"))  # 65,536 patterns at most
    sound = F.when(N.finite(F.col("value")), F.col("value")).otherwise(0.0) + 0.0
    return ids.join(back, "stable_id").select(F.col("bits").cast("int").alias("bits"), (~N.finite(F.col("value"))).alias("special"), sound.alias("value"))


def _static(spark, sf):  # noqa: ANN001, ANN202
    path = new_path(spark, "points") + ".ply"
    rows = points(spark, sf).select(F.col("stable_id").alias("id"), *[F.col(a).cast("float").alias(a) for a in "xyz"], F.col("opacity").cast("float").alias("opacity"))
    sink.write_file(rows, path, ["id", "x", "y", "z", "opacity"], "id", {"total_frames": "31"})
    return path


@query("F008_generic_scan", CLIP + "SELECT pos AS stable_id, id, x0 AS x, 1.0::DOUBLE AS rot_0, 0.0::DOUBLE AS rot_3, 15.0::DOUBLE AS lifetime_mu, 31.0::DOUBLE AS lifetime_w FROM clip", "points")
def f008(spark, sf):  # noqa: ANN001, ANN201
    return registry.open_points(spark, _static(spark, sf)).select("stable_id", "id", _d("x", "x"), *[_d(c, c) for c in ("rot_0", "rot_3", "lifetime_mu", "lifetime_w")])


MOTION = [*fourgs.REQUIRED]


def _motion(spark, sf):  # noqa: ANN001, ANN202
    p = points(spark, sf)
    value = {"x": F.col("x"), "y": F.col("y"), "z": F.col("z"), "opacity": F.col("opacity"), "rot_0": F.lit(1.0), "velocity_per_frame_0": F.col("w") / 4, "frame_center": F.col("mu"), "sigma_frames": F.col("w"), "radius_frames": F.col("w") * 2}
    rows = p.select("stable_id", *[value.get(n, F.lit(0.0)).cast("float").alias(n) for n in MOTION])
    path, n = new_path(spark, "motion") + ".4gs", rows.count()
    comments = {fourgs.TITLE: "version 3", "normalized_time_frames": "0 29 30"}
    sink.write_file(rows, path, MOTION, "stable_id", comments, trailer=fourgs.footer(MOTION, n, 0, 29, 0.01))
    return path


@query("F009_linear_motion_scan", """MORE p AS (SELECT row_number() OVER (ORDER BY stable_id) - 1 AS stable_id, x::FLOAT::DOUBLE AS x, (w / 4)::FLOAT::DOUBLE AS v, mu, w, w * 2 AS radius, opacity FROM points),
s AS (SELECT *, CASE WHEN opacity >= 0 THEN -ln(1 + exp(-opacity)) ELSE opacity - ln(1 + exp(opacity)) END - ln(0.01) AS spare FROM p),
l AS (SELECT *, CASE WHEN spare < 0 THEN 0.0 ELSE radius + w * sqrt(spare) END AS reach FROM s),
e AS (SELECT *, greatest(0.0, least(29.0, mu - reach)) AS a, greatest(0.0, least(29.0, mu + reach)) AS b FROM l)
SELECT stable_id, round(((a + b) / 2)::FLOAT::DOUBLE, 3)::DOUBLE AS mu, round(((b - a) / 2)::FLOAT::DOUBLE, 3)::DOUBLE AS w, round((x + v * (a - mu))::FLOAT::DOUBLE, 2)::DOUBLE AS x0, round((x + v * (b - mu))::FLOAT::DOUBLE, 2)::DOUBLE AS x1 FROM e""", "points")
def f009(spark, sf):  # noqa: ANN001, ANN201
    rows = registry.open_points(spark, _motion(spark, sf))
    near = lambda c, n, d: (F.round(F.col(c).cast("double"), d) + 0.0).alias(n)
    return rows.select("stable_id", near("lifetime_mu", "mu", 3), near("lifetime_w", "w", 3), near("xyz_bank_0_0", "x0", 2), near("xyz_bank_1_0", "x1", 2))


#: A hundred customers to a container, their names and segments in a stream each.
STREAMS = "s AS (SELECT 'c' || lpad(CAST(c_custkey // 100 AS VARCHAR), 8, '0') AS file, 'names' AS stream, string_agg(c_name, chr(10) ORDER BY c_custkey) AS d FROM customer GROUP BY 1 UNION ALL SELECT 'c' || lpad(CAST(c_custkey // 100 AS VARCHAR), 8, '0'), 'segments', string_agg(c_mktsegment, chr(10) ORDER BY c_custkey) FROM customer GROUP BY 1)"


def _containers(spark, sf, codec="deflate"):  # noqa: ANN001, ANN202
    file = F.concat(F.lit("c"), F.lpad(F.floor(F.col("c_custkey") / 100).cast("string"), 8, "0"))
    streams = F.explode(F.array(*[F.struct(F.lit(n).alias("stream"), F.col(c).alias("v")) for n, c in (("names", "c_name"), ("segments", "c_mktsegment"))]))
    rows = read(spark, sf, "customer").select(file.alias("file"), "c_custkey", streams.alias("s")).select("file", "c_custkey", "s.*")
    lists = rows.groupBy("file", "stream").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "v"))).alias("l"))
    folder = new_path(spark, "containers")
    container.write_containers(lists.select("file", "stream", F.encode(F.array_join("l.v", "\n"), "UTF-8").alias("data")), folder, 1, codec).count()
    return spark.read.format("binaryFile").load(folder)


_file = lambda: F.element_at(F.split("path", "/"), -1).alias("file")


@query("F011_container_scan", f"WITH {STREAMS} SELECT file, 1 AS version, stream, 'deflate' AS codec, octet_length(encode(d))::BIGINT AS raw_size, sha256(d) AS raw_sha FROM s")
def f011(spark, sf):  # noqa: ANN001, ANN201
    return container.manifests(_containers(spark, sf)).select(_file(), "version", "stream", "codec", "raw_size", "raw_sha")


@query("F012_stream_read", f"WITH {STREAMS} SELECT file, stream, md5(d) AS digest FROM s")
def f012(spark, sf):  # noqa: ANN001, ANN201
    return container.read_streams(_containers(spark, sf, "shuffle16-deflate")).select(_file(), "stream", F.md5("data").alias("digest"))


ROUTES = "CASE lower(regexp_extract(name, '[^.]*$')) WHEN 'raw4d' THEN 'RAW4D' WHEN 'ply4' THEN 'PLY4' WHEN '4gs' THEN '4GS' WHEN 'sog' THEN 'SOG' WHEN 'ply' THEN 'PLY' WHEN '4cgs' THEN '4CGS' END"


@query("F013_format_routing", f"WITH n AS (SELECT page_id, url || ['.RAW4D', '.ply4', '.4gs', '.Sog', '.PLY', '.4cgs', '.html', 'x', ''][page_id % 9 + 1] AS name FROM pages) SELECT page_id, name, {ROUTES} AS format FROM n")
def f013(spark, sf):  # noqa: ANN001, ANN201
    ends = F.array(*[F.lit(e) for e in (".RAW4D", ".ply4", ".4gs", ".Sog", ".PLY", ".4cgs", ".html", "x", "")])
    names = read(spark, sf, "pages").select("page_id", F.concat("url", F.get(ends, F.col("page_id") % 9)).alias("name"))
    return names.select("page_id", "name", registry.format_of(F.col("name")).alias("format"))


MESH = "v AS (SELECT c_custkey AS v, c_acctbal::FLOAT::DOUBLE AS x, c_nationkey::FLOAT::DOUBLE AS y FROM customer), t AS (SELECT v AS a, v + 1 AS b, v + 2 AS c FROM v WHERE v + 2 < (SELECT count(*) FROM v))"


def _mesh_file(spark, sf):  # noqa: ANN001, ANN202
    c = read(spark, sf, "customer")
    v = c.select(F.col("c_custkey").alias("v"), F.col("c_acctbal").cast("float").alias("x"), F.col("c_nationkey").cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"), (F.col("c_custkey") % 256).cast("int").alias("red"))
    n = c.count()
    t = v.where(F.col("v") < n - 2).select(F.col("v").alias("t"), F.col("v").alias("a"), (F.col("v") + 1).alias("b"), (F.col("v") + 2).alias("c"))
    path = new_path(spark, "mesh") + ".ply"
    mesh.write_mesh(v, t, path)
    return path


@query("F015_mesh_scan", f"WITH {MESH} SELECT p.v AS a, p.x, p.y, q.x AS bx, o.y AS cy FROM t JOIN v p ON p.v = t.a JOIN v q ON q.v = t.b JOIN v o ON o.v = t.c")
def f015(spark, sf):  # noqa: ANN001, ANN201
    v, t = mesh.read_mesh(spark, _mesh_file(spark, sf))
    at = lambda k: v.select(F.col("v").alias(k), _d("x", f"x{k}"), _d("y", f"y{k}"))
    rows = t.join(at("a"), "a").join(at("b"), "b").join(at("c"), "c")
    return rows.select("a", F.col("xa").alias("x"), F.col("ya").alias("y"), F.col("xb").alias("bx"), F.col("yc").alias("cy"))


@query("F016_track_scan", CLIP + """SELECT pos AS stable_id, 'xyz' AS track, 0 AS k, 0 AS frame, x0 AS c0, z0 AS c2 FROM clip UNION ALL SELECT pos, 'xyz', 1, 30, x1, z1 FROM clip UNION ALL SELECT pos, 'opacity', 0, 0, o, NULL FROM clip""", "points")
def f016(spark, sf):  # noqa: ANN001, ANN201
    path = _clip(spark, sf)
    header = ply.read_header(path)
    banks = ply.bank_columns([n for e in header.elements for n, _ in e.properties])
    rows = ply.tracks(_load(spark, path, columns=",".join(sum(banks.values(), []))), banks, {"xyz": int(header.comments["xyz_stride"])})
    return rows.select("stable_id", "track", "k", "frame", F.get("c", F.lit(0)).alias("c0"), F.get("c", F.lit(2)).alias("c2"))


@query("F021_source_compaction", CLIP + "SELECT id, x0, y1, o FROM clip WHERE NOT deleted", "points")
def f021(spark, sf):  # noqa: ANN001, ANN201
    path = _clip(spark, sf)
    ids = _load(spark, path, columns="id").select("stable_id", "id")
    gone = ids.join(points(spark, sf).where("deleted").select(F.col("stable_id").alias("id")), "id").select("stable_id")
    out = new_path(spark, "compacted") + ".raw4d"
    sink.compact_source(spark, path, gone, out)
    return _load(spark, out).select("id", _d("xyz_bank_0_0", "x0"), _d("xyz_bank_1_1", "y1"), _d("opacity_bank_0", "o"))


@query("F024_lossless_bundle", "SELECT page_id, sha256(coalesce(html, '')) AS sha, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages")
def f024(spark, sf):  # noqa: ANN001, ANN201
    rows = read(spark, sf, "pages").select(F.col("page_id").alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data"))
    return unbundle(bundle(rows, chunk=1_000)).select(F.col("name").alias("page_id"), F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("n"))


@query("F025_save_as", f"WITH {STREAMS} SELECT file, 2 AS version, stream, sha256(d) AS sha FROM s")
def f025(spark, sf):  # noqa: ANN001, ANN201
    folder = new_path(spark, "saved")
    container.save_as(_containers(spark, sf), {"version": 2}, folder).count()
    again = spark.read.format("binaryFile").load(folder)
    told = container.manifests(again).select("path", "stream", "version")
    return container.read_streams(again).join(told, ["path", "stream"]).select(_file(), "version", "stream", F.sha2("data", 256).alias("sha"))


@query("F027_mesh_write", f"WITH {MESH} SELECT v, x, y, 0.0::DOUBLE AS nz, (v % 256)::INTEGER AS red, 255 AS alpha FROM v")
def f027(spark, sf):  # noqa: ANN001, ANN201
    v, _ = mesh.read_mesh(spark, _mesh_file(spark, sf))
    return v.select("v", _d("x", "x"), _d("y", "y"), _d("nz", "nz"), "red", "alpha")
