"""Quantization, fits, meshes and consensus (F801 to F830)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import codebooks as C
from ..operators import field as V
from ..operators import fits as Z
from ..operators import mesh as M
from ..operators import residual as R
from ..operators import streams as X
from ..operators.graph import components
from ..operators.layout import dense_ids
from ..operators.stats import quantiles
from .base import keys, points, query, read, signal, vectors
from .layout import CODE, _coded
from .sampling import r


def _scalar_rounds(k: int, rounds: int) -> str:
    """SQL of the codebook: quantiles, then means by nearest code, round after round."""
    steps = [f"MORE c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY m) - 1 AS i, m FROM (SELECT unnest(quantile_cont(x, [{', '.join(str((i + 0.5) / k) for i in range(k))}])) AS m FROM points))"]
    for n in range(rounds):
        steps.append(f"d{n} AS (SELECT i, m, lead(m) OVER (ORDER BY i) AS above, lag(m) OVER (ORDER BY i) AS below FROM c{n}), a{n} AS (SELECT d.i, avg(p.x) AS m FROM points p JOIN d{n} d ON (d.below IS NULL OR p.x > (d.below + d.m) / 2) AND (d.above IS NULL OR p.x <= (d.m + d.above) / 2) GROUP BY 1), "
                     f"c{n + 1} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY v) - 1 AS i, v AS m FROM (SELECT coalesce(a.m, c.m) AS v FROM c{n} c LEFT JOIN a{n} a USING (i)))")
    return ", ".join(steps) + f" SELECT i::INTEGER AS code, round(m, 6)::DOUBLE AS value FROM c{rounds}"


@query("F801_scalar_codebook", _scalar_rounds(16, 6), "points")
def f801(spark, sf):  # noqa: ANN001, ANN201
    codes = C.scalar_codebook(points(spark, sf), "x", 4)
    return spark.createDataFrame(list(enumerate(codes)), "code int, value double").select("code", r(F.col("value"), "value"))


@query("F802_scalar_assign", "SELECT stable_id, ((x > 75)::INTEGER + (x > 200)::INTEGER + (x > 375)::INTEGER)::INTEGER AS code, abs(x - [50, 100, 300, 450][1 + (x > 75)::INTEGER + (x > 200)::INTEGER + (x > 375)::INTEGER]) > 40 AS exact FROM points", "points")
def f802(spark, sf):  # noqa: ANN001, ANN201
    codes = [50.0, 100.0, 300.0, 450.0]
    rows = points(spark, sf).withColumn("code", C.nearest_scalar(F.col("x"), codes))
    value = F.get(F.array(*[F.lit(c) for c in codes]), F.col("code"))
    return rows.select("stable_id", "code", (F.abs(F.col("x") - value) > 40).alias("exact"))


SEEDS = 8


def _means_rounds(rounds: int) -> str:
    """SQL of k-means: vectors by their number seed it, each round takes the nearest centres' means."""
    far = "list_sum(list_transform(list_zip(p.e, c.e), lambda x: (x[1] - x[2]) ** 2))"
    steps = [f"MORE n AS MATERIALIZED (SELECT vec_id, e, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM vectors), c0 AS MATERIALIZED (SELECT s.c, n.e FROM (SELECT unnest(range({SEEDS})) AS c) s JOIN n ON n.i = (s.c * 7919) % n.n)"]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS code, min(d) AS d2 FROM (SELECT p.vec_id, c.c, {far} AS d FROM vectors p, c{k} c) GROUP BY 1)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT code, list(m ORDER BY j) AS e FROM (SELECT code, j, avg(v) AS m FROM (SELECT a.code, generate_subscripts(p.e, 1) AS j, unnest(p.e) AS v FROM a{k} a JOIN vectors p USING (vec_id)) GROUP BY 1, 2) GROUP BY 1), c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN m{k} m ON m.code = c.c)")
    return ", ".join(steps) + f" SELECT vec_id, code::INTEGER AS code, round(d2, 5)::DOUBLE AS d2 FROM a{rounds}"


@query("F803_kmeans", _means_rounds(3), "vectors")
def f803(spark, sf):  # noqa: ANN001, ANN201
    v = dense_ids(vectors(spark, sf), ["vec_id"], "i")
    at = C.seed_index(SEEDS, v.count())
    found = {x["i"]: x["e"] for x in v.where(F.col("i").isin(at)).select("i", "e").collect()}  # 8 rows
    return C.assign(v, "e", C.kmeans(v, "e", [found[i] for i in at], 3)).select("vec_id", "code", (F.round("d2", 5) + 0.0).alias("d2"))


CENTRES = [[1.0 if j == i else 0.0 for j in range(4)] for i in range(4)]
D2 = ["((e[1]-{})**2 + (e[2]-{})**2 + (e[3]-{})**2 + (e[4]-{})**2)".format(*c) for c in CENTRES]


@query("F829_nearest_code", f"SELECT vec_id, (list_position([{', '.join(D2)}], least({', '.join(D2)})) - 1)::INTEGER AS code, round(least({', '.join(D2)}), 6)::DOUBLE AS d2 FROM vectors", "vectors")
def f829(spark, sf):  # noqa: ANN001, ANN201
    rows = vectors(spark, sf).select("vec_id", F.slice("e", 1, 4).alias("e"))
    return C.assign(rows, "e", CENTRES).select("vec_id", "code", r(F.col("d2"), "d2"))


@query("F805_tree_codebook")
def f805(spark, sf):  # noqa: ANN001, ANN201
    v = vectors(spark, sf).select("vec_id", F.slice("e", 1, 6).alias("e"))
    tree = C.tree_codebook(v, "e", 8, 5)
    return v.select("vec_id", C.descend(F.col("e"), tree, 8).alias("leaf"))


@query("F806_tree_assign", "SELECT vec_id, CASE WHEN e[1] > 0 THEN CASE WHEN e[2] > 0 THEN 7 ELSE 6 END ELSE CASE WHEN e[3] > 0 THEN 5 ELSE 4 END END::INTEGER AS leaf FROM vectors", "vectors")
def f806(spark, sf):  # noqa: ANN001, ANN201
    tree = {1: ([-1, 0, 0], [1, 0, 0]), 2: ([0, 0, -1], [0, 0, 1]), 3: ([0, -1, 0], [0, 1, 0])}
    rows = vectors(spark, sf).select("vec_id", F.slice("e", 1, 3).alias("e"))
    return rows.select("vec_id", C.descend(F.col("e"), tree, 2).alias("leaf"))


@query("F810_sparse_pursuit", "SELECT vec_id, (list_position([abs(e[1]), abs(e[2]), abs(e[3]), abs(e[4])], greatest(abs(e[1]), abs(e[2]), abs(e[3]), abs(e[4]))) - 1)::INTEGER AS first_atom, round(e[1]**2 + e[2]**2 + e[3]**2 + e[4]**2 - list_sum(list_sort([e[1]**2, e[2]**2, e[3]**2, e[4]**2], 'DESC')[1:2]), 6)::DOUBLE AS residual FROM vectors", "vectors")
def f810(spark, sf):  # noqa: ANN001, ANN201
    rows = C.pursue(vectors(spark, sf).select("vec_id", F.slice("e", 1, 4).alias("e")), "e", CENTRES, 2)
    return rows.select("vec_id", F.get("picks", F.lit(0))["atom"].alias("first_atom"), r(F.col("residual"), "residual"))


@query("F807_exceptions", """MORE q AS (SELECT stable_id, abs(x - 250) / 250 AS err FROM points), b AS (SELECT least(4095, floor(err / 0.8 * 4096))::INTEGER AS b, count(*) AS n, sum(err * err) AS s FROM q WHERE err <= 0.8 GROUP BY 1),
c AS (SELECT b, sum(s) OVER (ORDER BY b) AS run FROM b), k AS (SELECT coalesce(max(b), -1) AS cut FROM c WHERE sqrt(run / (SELECT count(*) FROM q)) <= 0.3) SELECT stable_id, err > 0.8 OR least(4095, floor(err / 0.8 * 4096)) > cut AS repair FROM q, k""", "points")
def f807(spark, sf):  # noqa: ANN001, ANN201
    rows = points(spark, sf).select("stable_id", (F.abs(F.col("x") - 250) / 250).alias("err"))
    return C.exceptions(rows, "err", 0.8, 0.3).select("stable_id", "repair")


@query("F809_motion_grid", """MORE c AS (SELECT floor(x / 20) + cx AS nx, floor(y / 400) + cy AS ny, (CASE WHEN cx = 1 THEN x / 20 - floor(x / 20) ELSE 1 - (x / 20 - floor(x / 20)) END) * (CASE WHEN cy = 1 THEN y / 400 - floor(y / 400) ELSE 1 - (y / 400 - floor(y / 400)) END) AS w, z FROM points, (VALUES (0), (1)) a(cx), (VALUES (0), (1)) b(cy))
SELECT nx::BIGINT AS nx, ny::BIGINT AS ny, round(sum(w), 6)::DOUBLE AS weight, round(sum(w * z) / sum(w), 4)::DOUBLE AS z FROM c WHERE w > 0 GROUP BY 1, 2""", "points")
def f809(spark, sf):  # noqa: ANN001, ANN201
    rows = points(spark, sf).select(F.col("x"), (F.col("y") / 20).alias("y"), "z")
    out = Z.grid_scatter(rows, ["z"], 20.0, ["x", "y"])
    return out.select("nx", "ny", r(F.col("weight"), "weight"), (F.round("z", 4) + 0.0).alias("z"))


@query("F812_block_fit", "SELECT vec_id % 7 AS block, count(*) AS n, 0.0::DOUBLE AS m00, 2.0::DOUBLE AS m01, 0.0::DOUBLE AS m02, -2.0::DOUBLE AS m10, 0.0::DOUBLE AS m11, 2.0::DOUBLE AS m22, 1.0::DOUBLE AS tx, -3.0::DOUBLE AS tz, 0.0::DOUBLE AS rmse FROM vectors GROUP BY 1", "vectors")
def f812(spark, sf):  # noqa: ANN001, ANN201
    """Pairs under a known turn, scale and shift, which the fit must find; parameters in steps of 2**-12."""
    e = lambda i: F.get("e", F.lit(i))
    pairs = vectors(spark, sf).select((F.col("vec_id") % 7).alias("block"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), (2 * e(1) + 1).alias("u"), (-2 * e(0)).alias("v"), (2 * e(2) - 3).alias("w"))
    fitted = Z.quantized(Z.fit_blocks(pairs, "block", "similarity"), 12)
    return fitted.select("block", "n", *["m00", "m01", "m02", "m10", "m11", "m22", "tx", "tz"], r(F.col("rmse"), "rmse"))


SUMS = [(a, b) for a in "xyz" for b in "xyzuvw"]
COFACTOR = {"xx": "yy*zz-yz*yz", "xy": "xz*yz-xy*zz", "xz": "xy*yz-xz*yy", "yy": "xx*zz-xz*xz", "yz": "xy*xz-xx*yz", "zz": "xx*yy-xy*xy"}


@query("F811_affine_fit", "MORE p AS (SELECT vec_id % 7 AS block, e[1] AS x, e[2] AS y, e[3] AS z, 3 * e[1] + e[2] + e[4] AS u, e[2] - e[3] + e[5] / 2 AS v, 2 * e[3] - 3 + e[6] AS w FROM vectors), "
    f"s AS (SELECT block, count(*) AS n, {', '.join(f'avg({c}) AS m{c}' for c in 'xyzuvw')}, {', '.join(f'covar_pop({a}, {b}) AS {a}{b}' for a, b in SUMS)} FROM p GROUP BY 1), "
    f"i AS (SELECT *, xx*yy*zz + 2*xy*xz*yz - xx*yz*yz - yy*xz*xz - zz*xy*xy AS det, {', '.join(f'{v} AS i{k}' for k, v in COFACTOR.items())} FROM s), "
    f"l AS (SELECT *, {', '.join('(' + ' + '.join('i%s * %s%s' % (''.join(sorted(a + b)), b, t) for b in 'xyz') + f') / det AS m{j}{k}' for j, t in enumerate('uvw') for k, a in enumerate('xyz'))} FROM i) "
    f"SELECT block, n, {', '.join(f'round(m{j}{k}, 4)::DOUBLE AS m{j}{k}' for j in range(3) for k in range(3))}, {', '.join(f'round(m{t} - m{j}0 * mx - m{j}1 * my - m{j}2 * mz, 4)::DOUBLE AS t{a}' for j, (t, a) in enumerate(zip('uvw', 'xyz')))} FROM l", "vectors")  # fmt: skip
def f811(spark, sf):  # noqa: ANN001, ANN201
    e = lambda i: F.get("e", F.lit(i))
    pairs = vectors(spark, sf).select((F.col("vec_id") % 7).alias("block"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), (3 * e(0) + e(1) + e(3)).alias("u"), (e(1) - e(2) + e(4) / 2).alias("v"), (2 * e(2) - 3 + e(5)).alias("w"))
    return Z.fit_blocks(pairs, "block", "affine").select("block", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in [f"m{j}{k}" for j in range(3) for k in range(3)] + ["tx", "ty", "tz"]])


@query("F814_hash_grid", """MORE h AS (SELECT track, k, v, x, y, z, ((xor(xor(floor(x / 8)::BIGINT * 73856093, floor(y / 8)::BIGINT * 19349663), floor(z / 8)::BIGINT * 83492791)) % 512) AS bucket FROM keys),
m AS (SELECT bucket, floor(avg(v) + 0.5) AS m FROM h GROUP BY 1) SELECT track, k, CAST(v - m AS BIGINT) AS residual FROM h JOIN m USING (bucket)""", "keys")
def f814(spark, sf):  # noqa: ANN001, ANN201
    rows = keys(spark, sf).select("track", "k", "v", F.col("x"), F.col("y"), F.col("z"))
    return C.hash_grid(rows, ["v"], ["x", "y", "z"], 8.0, 512).select("track", "k", F.col("v").cast("long").alias("residual"))


def rans_round_trip(docs):  # noqa: ANN001, ANN201
    """``(doc_id, n, digest)``: bytes of each text and the MD5 of what decoding its code gives; null for a null text."""
    import hashlib

    import pandas as pd

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for d, raw in zip(pdf["doc_id"], pdf["raw"], strict=True):
                if raw is None:
                    out.append((d, None, None))
                    continue
                counts = [0] * 256
                for b in raw:
                    counts[b] += 1
                freqs = X.normalized_frequencies(counts)
                out.append((d, len(raw), hashlib.md5(X.rans_decode(X.rans_encode(raw, freqs), freqs, len(raw))).hexdigest()))
            ids, n, digest = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n": pd.array(n, "Int64"), "digest": pd.array(digest, "string")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("raw"))
    return rows.mapInPandas(run, "doc_id long, n long, digest string")


@query("F815_rans_round_trip", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n, md5(text) AS digest FROM documents")
def f815(spark, sf):  # noqa: ANN001, ANN201
    return rans_round_trip(read(spark, sf, "documents"))


GOLOMB = " UNION ALL ".join(f"SELECT {m} AS divisor, sum(code // {m} + 1 + {'0' if m == 1 else f'CASE WHEN code % {m} < {(1 << (m - 1).bit_length()) - m} THEN {(m - 1).bit_length() - 1} ELSE {(m - 1).bit_length()} END'})::BIGINT AS bits FROM signal" for m in (1, 100, 512, 1000, 2048))


@query("F816_golomb_cost", GOLOMB, "signal")
def f816(spark, sf):  # noqa: ANN001, ANN201
    return X.golomb_cost(signal(spark, sf), "code", [1, 100, 512, 1000, 2048])


#: Rounds in which the smallest label spreads over neighbours; the graph of orders and parts is a few edges across.
SPREAD = 16


def _spread_rounds() -> str:
    edges = "WITH e AS MATERIALIZED (SELECT DISTINCT l_orderkey AS a, 10000000 + l_partkey AS b FROM lineitem), u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), l0 AS MATERIALIZED (SELECT DISTINCT a AS v, a AS root FROM u)"
    steps = [f"l{i + 1} AS MATERIALIZED (SELECT l.v, least(l.root, m.root) AS root FROM l{i} l JOIN (SELECT u.a AS v, min(o.root) AS root FROM u JOIN l{i} o ON o.v = u.b GROUP BY 1) m USING (v))" for i in range(SPREAD)]
    return ", ".join([edges, *steps]) + f" SELECT v, root FROM l{SPREAD}"


@query("F817_connected_components", _spread_rounds())
def f817(spark, sf):  # noqa: ANN001, ANN201
    return components(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 10_000_000).alias("b")).distinct())


def line_triangles(spark, sf):  # noqa: ANN001, ANN201
    """``(t, a, b, c)``: a triangle of order, part and supplier for each distinct three on a line; the kinds' numbers never meet."""
    lines = read(spark, sf, "lineitem").where("l_orderkey is not null and l_partkey is not null and l_suppkey is not null")
    corners = [(F.col(f"l_{k}key").cast("long") * 3 + i).alias(c) for i, (k, c) in enumerate(zip(("order", "part", "supp"), "abc", strict=True))]
    return lines.select(*corners).distinct().select(F.concat_ws("/", "a", "b", "c").alias("t"), "a", "b", "c")


def _large_rounds() -> str:
    """SQL of the filter: the smallest corner's label spreads over triangles."""
    start = f"WITH {CORNERS}, m0 AS MATERIALIZED (SELECT a, b, c, a AS root FROM x)"
    steps = []
    for i in range(SPREAD):
        steps.append(f"v{i} AS MATERIALIZED (SELECT v, min(root) AS root FROM (SELECT unnest([a, b, c]) AS v, least(root, a, b, c) AS root FROM m{i}) GROUP BY 1), m{i + 1} AS MATERIALIZED (SELECT m.a, m.b, m.c, least(p.root, q.root, o.root) AS root FROM m{i} m JOIN v{i} p ON p.v = m.a JOIN v{i} q ON q.v = m.b JOIN v{i} o ON o.v = m.c)")
    last = f"n AS (SELECT root, count(*) AS n FROM m{SPREAD} GROUP BY 1) SELECT concat_ws('/', a, b, c) AS t, a, b, c, root, n FROM m{SPREAD} JOIN n USING (root) WHERE n >= greatest(24, floor((SELECT max(n) FROM n) * 0.0015))"
    return ", ".join([start, *steps, last])


CORNERS = "x AS (SELECT DISTINCT 3 * l_orderkey AS a, 3 * l_partkey + 1 AS b, 3 * l_suppkey + 2 AS c FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL)"


@query("F817_large_components", _large_rounds())
def f817_large(spark, sf):  # noqa: ANN001, ANN201
    return M.large_components(line_triangles(spark, sf))


#: A strip of triangles over all points in the order of their ids.
TRI = """tri AS (SELECT p.stable_id AS t, p.stable_id AS a, p.stable_id + 1 AS b, p.stable_id + 3 AS c FROM points p JOIN points q ON q.stable_id = p.stable_id + 1 JOIN points o ON o.stable_id = p.stable_id + 3),
vert AS (SELECT stable_id AS v, x, y, z FROM points)"""
FLAT = """f AS (SELECT t.*, pa.x AS ax, pa.y AS ay, pa.z AS az, pb.x AS bx, pb.y AS by_, pb.z AS bz, pc.x AS cx, pc.y AS cy, pc.z AS cz, (pb.y - pa.y) * (pc.z - pa.z) - (pb.z - pa.z) * (pc.y - pa.y) AS nx, (pb.z - pa.z) * (pc.x - pa.x) - (pb.x - pa.x) * (pc.z - pa.z) AS ny, (pb.x - pa.x) * (pc.y - pa.y) - (pb.y - pa.y) * (pc.x - pa.x) AS nz
  FROM tri t JOIN {v} pa ON pa.v = t.a JOIN {v} pb ON pb.v = t.b JOIN {v} pc ON pc.v = t.c)"""


def _mesh(spark, sf):  # noqa: ANN001, ANN202
    p = points(spark, sf)
    ids = p.select(F.col("stable_id").alias("t"), F.col("stable_id").alias("a"), (F.col("stable_id") + 1).alias("b"), (F.col("stable_id") + 3).alias("c"))
    there = lambda c: p.select(F.col("stable_id").alias(c))
    return ids.join(there("b"), "b", "left_semi").join(there("c"), "c", "left_semi").select("t", "a", "b", "c"), p.select(F.col("stable_id").alias("v"), "x", "y", "z")


@query("F818_vertex_normals", f"""MORE {TRI}, {FLAT.format(v='vert')}, n AS (SELECT unnest([a, b, c]) AS v, nx AS x, ny AS y, nz AS z FROM f), s AS (SELECT v, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM n GROUP BY 1)
SELECT v, round(x / sqrt(x*x+y*y+z*z), 6) AS nx, round(y / sqrt(x*x+y*y+z*z), 6) AS ny, round(z / sqrt(x*x+y*y+z*z), 6) AS nz FROM s""", "points")
def f818(spark, sf):  # noqa: ANN001, ANN201
    return M.vertex_normals(*_mesh(spark, sf)).select("v", *[r(F.col(f"n{a}"), f"n{a}") for a in "xyz"])


ANGLE = "acos(greatest(-1, least(1, (({q}x-{p}x)*({s}x-{p}x) + ({q}{y}-{p}{y})*({s}{y}-{p}{y}) + ({q}z-{p}z)*({s}z-{p}z)) / greatest(1e-20, sqrt(({q}x-{p}x)**2 + ({q}{y}-{p}{y})**2 + ({q}z-{p}z)**2) * sqrt(({s}x-{p}x)**2 + ({s}{y}-{p}{y})**2 + ({s}z-{p}z)**2)))))"
ANGLES = ", ".join(ANGLE.format(p=p, q=q, s=s, y="y") for p, q, s in ("abc", "bca", "cab")).replace("by", "by_")


@query("F818_angle_normals", f"""MORE {TRI}, {FLAT.format(v='vert')}, n AS (SELECT unnest([a, b, c]) AS v, unnest([{ANGLES}]) / sqrt(nx*nx + ny*ny + nz*nz) AS w, nx, ny, nz FROM f), s AS (SELECT v, sum(nx * w) AS x, sum(ny * w) AS y, sum(nz * w) AS z FROM n GROUP BY 1)
SELECT v, round(x / sqrt(x*x+y*y+z*z), 5) AS nx, round(y / sqrt(x*x+y*y+z*z), 5) AS ny, round(z / sqrt(x*x+y*y+z*z), 5) AS nz FROM s""", "points")
def f818_angle(spark, sf):  # noqa: ANN001, ANN201
    return M.vertex_normals(*_mesh(spark, sf), weight="angle").select("v", *[(F.round(f"n{a}", 5) + 0.0).alias(f"n{a}") for a in "xyz"])


def _smooth_rounds(spacing: float, rounds: int) -> str:
    wide = 2 * (2.5 * spacing) ** 2
    steps = [f"MORE {TRI}, g AS (SELECT unnest([a, b, b, c, c, a]) AS u, unnest([b, a, c, b, a, c]) AS v FROM tri), nb AS MATERIALIZED (SELECT u, v, count(*) AS m FROM g GROUP BY ALL), w0 AS MATERIALIZED (SELECT * FROM vert)"]
    for k in range(rounds):
        steps.append(FLAT.format(v=f"w{k}").replace("f AS (", f"f{k} AS (", 1))
        steps.append(f"s{k} AS (SELECT v, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM (SELECT unnest([a, b, c]) AS v, nx, ny, nz FROM f{k}) GROUP BY 1), o{k} AS MATERIALIZED (SELECT w.v, w.x, w.y, w.z, coalesce(s.x / sqrt(s.x**2 + s.y**2 + s.z**2), 0) AS nx, coalesce(s.y / sqrt(s.x**2 + s.y**2 + s.z**2), 0) AS ny, coalesce(s.z / sqrt(s.x**2 + s.y**2 + s.z**2), 0) AS nz FROM w{k} w LEFT JOIN s{k} s USING (v))")
        steps.append(f"p{k} AS (SELECT nb.u, nb.m, q.nx * p.nx + q.ny * p.ny + q.nz * p.nz AS dot, (q.x - p.x)**2 + (q.y - p.y)**2 + (q.z - p.z)**2 AS far, (q.x - p.x) * p.nx + (q.y - p.y) * p.ny + (q.z - p.z) * p.nz AS h FROM nb JOIN o{k} p ON p.v = nb.u JOIN o{k} q ON q.v = nb.v)")
        steps.append(f"q{k} AS (SELECT u AS v, sum(h * w) AS h, sum(w) AS w FROM (SELECT *, m * exp(-far / {wide}) * exp(-((1 - greatest(-1, least(1, dot)))**2) / (2 * 0.18 * 0.18)) AS w FROM p{k} WHERE dot >= cos(radians(35)) AND far <= {(4.5 * spacing) ** 2}) GROUP BY 1)")
        steps.append(f"m{k} AS (SELECT o.*, CASE WHEN q.w > 1e-8 THEN greatest(-{spacing / 4}, least({spacing / 4}, q.h / q.w * 0.45)) ELSE 0 END AS step FROM o{k} o LEFT JOIN q{k} q USING (v)), d{k} AS (SELECT m.v, b.x AS bx, b.y AS by_, b.z AS bz, m.x + nx * step - b.x AS dx, m.y + ny * step - b.y AS dy, m.z + nz * step - b.z AS dz FROM m{k} m JOIN w0 b USING (v))")
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT v, bx + dx * s AS x, by_ + dy * s AS y, bz + dz * s AS z FROM (SELECT *, CASE WHEN sqrt(dx*dx + dy*dy + dz*dz) > {spacing / 2} THEN {spacing / 2} / sqrt(dx*dx + dy*dy + dz*dz) ELSE 1 END AS s FROM d{k}))")
    return ", ".join(steps) + f" SELECT v, round(x, 3)::DOUBLE AS x, round(y, 3)::DOUBLE AS y, round(z, 3)::DOUBLE AS z FROM w{rounds}"


@query("F819_mesh_smoothing", _smooth_rounds(400.0, 2), "points")
def f819(spark, sf):  # noqa: ANN001, ANN201
    tri, vert = _mesh(spark, sf)
    return M.smooth(vert, tri, 400.0, rounds=2).select("v", *[(F.round(a, 3) + 0.0).alias(a) for a in "xyz"])


@query("F820_border_edges", f"WITH {CORNERS}, e AS (SELECT least(a, b) AS u, greatest(a, b) AS v FROM x UNION ALL SELECT least(b, c), greatest(b, c) FROM x UNION ALL SELECT least(c, a), greatest(c, a) FROM x) SELECT u, v FROM e GROUP BY 1, 2 HAVING count(*) = 1")
def f820(spark, sf):  # noqa: ANN001, ANN201
    return M.border_edges(line_triangles(spark, sf))


#: Customers on a sheet ten wide, two triangles a square, one square in 37 left out.
SHEET = """n AS (SELECT c_custkey AS v, c_acctbal AS x, c_custkey // 10 AS y, c_custkey % 10 AS z FROM customer), q AS (SELECT v FROM n WHERE v % 10 < 9 AND v + 11 <= (SELECT max(v) FROM n) AND v % 37 != 5),
tr AS (SELECT v AS a, v + 1 AS b, v + 10 AS c FROM q UNION ALL SELECT v + 1, v + 11, v + 10 FROM q), d AS (SELECT unnest([a, b, c]) AS p, unnest([b, c, a]) AS o FROM tr),
br AS MATERIALIZED (SELECT least(p, o) AS u, greatest(p, o) AS v, any_value(p) AS p, any_value(o) AS o FROM d GROUP BY 1, 2 HAVING count(*) = 1), two AS (SELECT u AS a, v AS b FROM br UNION ALL SELECT v, u FROM br),
r AS (SELECT a AS v, a AS root FROM two UNION SELECT two.b, r.root FROM r JOIN two ON two.a = r.v), c AS MATERIALIZED (SELECT v, min(root) AS root FROM r GROUP BY 1), g AS (SELECT a AS v, count(*) AS deg FROM two GROUP BY 1),
l AS (SELECT c.root FROM c JOIN g USING (v) JOIN n USING (v) GROUP BY 1 HAVING count(*) BETWEEN 4 AND 64 AND max(deg) = 2 AND min(deg) = 2 AND sqrt((max(x) - min(x))**2 + (max(y) - min(y))**2 + (max(z) - min(z))**2) <= 9000)"""


@query("F820_filled_holes", f"WITH RECURSIVE {SHEET} SELECT br.o AS a, br.p AS b, -1 - c.root AS c FROM br JOIN c ON c.v = br.u WHERE c.root IN (SELECT root FROM l)")
def f820_fill(spark, sf):  # noqa: ANN001, ANN201
    n = read(spark, sf, "customer").select(F.col("c_custkey").alias("v"), F.col("c_acctbal").alias("x"), F.floor(F.col("c_custkey") / 10).alias("y"), (F.col("c_custkey") % 10).alias("z"))
    q = n.crossJoin(F.broadcast(n.agg(F.max("v").alias("top")))).where("v % 10 < 9 and v + 11 <= top and v % 37 != 5")
    v = F.col("v")
    return M.fill_holes(q.select(v.alias("a"), (v + 1).alias("b"), (v + 10).alias("c")).union(q.select(v + 1, v + 11, v + 10)), n, 9000.0)[0]


@query("F821_signed_volume", f"MORE {TRI} SELECT round(sum(pa.x * (pb.y * pc.z - pb.z * pc.y) + pa.y * (pb.z * pc.x - pb.x * pc.z) + pa.z * (pb.x * pc.y - pb.y * pc.x)) / 6 / 1e9, 3) AS volume, count(*) AS triangles FROM tri t JOIN vert pa ON pa.v = t.a JOIN vert pb ON pb.v = t.b JOIN vert pc ON pc.v = t.c", "points")
def f821(spark, sf):  # noqa: ANN001, ANN201
    return M.signed_volume(*_mesh(spark, sf)).select((F.round(F.col("volume") / 1e9, 3) + 0.0).alias("volume"), "triangles")


@query("F824_consensus_direction", """MORE v AS (SELECT vec_id // 12 AS pose, vec_id AS view, e[1] / n AS x, e[2] / n AS y, e[3] / n AS z, abs(e[4]) AS w FROM (SELECT *, sqrt(e[1]**2 + e[2]**2 + e[3]**2) AS n FROM vectors)),
p AS (SELECT a.pose, a.view AS seed, b.* FROM v a JOIN v b ON b.pose = a.pose AND a.x * b.x + a.y * b.y + a.z * b.z >= cos(radians(55))), s AS (SELECT pose, seed, sum(w) AS score, sum(w * x) AS x, sum(w * y) AS y, sum(w * z) AS z, count(*) AS n FROM p GROUP BY 1, 2),
t AS (SELECT pose, max(score) AS top FROM s GROUP BY 1), f AS (SELECT s.pose, min(seed) AS seed FROM s JOIN t USING (pose) WHERE score >= top - 1e-12 GROUP BY 1), w AS (SELECT pose, sum(w) AS w FROM v GROUP BY 1)
SELECT s.pose, round(s.x / sqrt(s.x**2 + s.y**2 + s.z**2), 6) AS x, round(s.y / sqrt(s.x**2 + s.y**2 + s.z**2), 6) AS y, round(s.z / sqrt(s.x**2 + s.y**2 + s.z**2), 6) AS z, s.n::INTEGER AS inliers, round(s.score / w.w, 6) AS dominance FROM s JOIN f USING (pose, seed) JOIN w USING (pose)""", "vectors")
def f824(spark, sf):  # noqa: ANN001, ANN201
    e = lambda i: F.get("e", F.lit(i))
    n = F.sqrt(e(0) ** 2 + e(1) ** 2 + e(2) ** 2)
    views = vectors(spark, sf).select(F.floor(F.col("vec_id") / 12).alias("pose"), F.col("vec_id").alias("view"), (e(0) / n).alias("x"), (e(1) / n).alias("y"), (e(2) / n).alias("z"), F.abs(e(3)).alias("w"))
    return Z.consensus(views, "pose", "w").select("pose", *[r(F.col(a), a) for a in "xyz"], "inliers", r(F.col("dominance"), "dominance"))


@query("F826_verdict", "MORE g AS (SELECT track, count(*) AS views, max(x) / 50 AS dominance, avg(y) / 10 AS confidence FROM keys GROUP BY 1) SELECT track, CASE WHEN views >= 6 AND dominance >= 0.56 AND confidence >= 0.34 THEN 'direction' WHEN views >= 4 AND confidence >= 0.28 THEN 'centre' WHEN views >= 2 AND dominance >= 0.65 THEN 'semantic' ELSE 'rejected' END AS verdict FROM g", "keys")
def f826(spark, sf):  # noqa: ANN001, ANN201
    g = keys(spark, sf).groupBy("track").agg(F.count(F.lit(1)).alias("views"), (F.max("x") / 50).alias("dominance"), (F.avg("y") / 10).alias("confidence"))
    return g.select("track", Z.verdict("views", "dominance", "confidence").alias("verdict"))


@query("F827_rotation_modes", "MORE p AS (SELECT quantile_cont(x, 0.3) AS a, quantile_cont(x, 0.8) AS b, quantile_cont(x, 0.97) AS c FROM points) SELECT stable_id, ((x > a)::INTEGER + (x > b)::INTEGER + (x > c)::INTEGER)::INTEGER AS mode FROM points, p", "points")
def f827(spark, sf):  # noqa: ANN001, ANN201
    p = points(spark, sf)
    cuts = quantiles(p, "x", [0.3, 0.8, 0.97])
    return p.select("stable_id", sum((F.when(F.col("x") > c, 1).otherwise(0) for c in cuts[1:]), F.when(F.col("x") > cuts[0], 1).otherwise(0)).alias("mode"))


@query("F830_morton_inverse", f"SELECT stable_id, {CODE} AS again FROM points", "points")
def f830(spark, sf):  # noqa: ANN001, ANN201
    return _coded(spark, sf).select("stable_id", B.morton(*B.morton_inverse(F.col("code"))).alias("again"))


@query("F804_residual_trees")
def f804(spark, sf):  # noqa: ANN001, ANN201
    rows = vectors(spark, sf).select("vec_id", F.slice("e", 1, 12).alias("e"))
    return R.tree_levels(rows, "e", ["vec_id"], 2).select("vec_id", "labels", "error")


@query("F808_shared_codebooks")
def f808(spark, sf):  # noqa: ANN001, ANN201
    rows = vectors(spark, sf).select("vec_id", "label", F.slice("e", 1, 12).alias("e"))
    return R.shared_levels(rows, "e", ["vec_id"], "label", 64, 2).select("vec_id", "label", "labels", "error")


@query("F828_curve_bank")
def f828(spark, sf):  # noqa: ANN001, ANN201
    rows = vectors(spark, sf).select("vec_id", F.slice("e", 1, 15).alias("curve"), F.abs(F.get("e", F.lit(20))).alias("importance"))
    return R.curve_bank(rows, "curve", "importance", ["vec_id"], clusters=64).select("vec_id", "labels", "error")


NORM = "sqrt(e[4]**2 + e[5]**2 + e[6]**2 + e[7]**2)"
BLOBS = f"""MORE g AS (SELECT vec_id AS stable_id, e[1] * 40 AS x, e[2] * 40 AS y, e[3] * 40 AS z, e[4] / {NORM} AS w, e[5] / {NORM} AS qx, e[6] / {NORM} AS qy, e[7] / {NORM} AS qz, 0.6 + abs(e[8]) AS s0, 0.6 + abs(e[9]) AS s1, 0.8 AS s2 FROM vectors),
m AS (SELECT *, 1 - 2 * (qy*qy + qz*qz) AS r00, 2 * (qx*qy - qz*w) AS r01, 2 * (qx*qz + qy*w) AS r02, 2 * (qx*qy + qz*w) AS r10, 1 - 2 * (qx*qx + qz*qz) AS r11, 2 * (qy*qz - qx*w) AS r12, 2 * (qx*qz - qy*w) AS r20, 2 * (qy*qz + qx*w) AS r21, 1 - 2 * (qx*qx + qy*qy) AS r22 FROM g),
o AS (SELECT i FROM range(-5, 6) t(i)), n AS (SELECT m.*, floor(x)::BIGINT + a.i AS ix, floor(y)::BIGINT + b.i AS iy, floor(z)::BIGINT + c.i AS iz FROM m, o a, o b, o c),
d AS (SELECT *, ix + 0.5 - x AS dx, iy + 0.5 - y AS dy, iz + 0.5 - z AS dz FROM n),
f AS (SELECT *, ((dx*r00 + dy*r10 + dz*r20) / s0)**2 + ((dx*r01 + dy*r11 + dz*r21) / s1)**2 + ((dx*r02 + dy*r12 + dz*r22) / s2)**2 AS far FROM d),
field AS MATERIALIZED (SELECT ix, iy, iz, sum(0.8 * exp(-far / 2)) AS density FROM f WHERE far <= 9 GROUP BY ALL)"""


def _blobs(spark, sf):  # noqa: ANN001, ANN202
    e = lambda i: F.get("e", F.lit(i))
    at = {"x": e(0) * 40, "y": e(1) * 40, "z": e(2) * 40, "qw": e(3), "qx": e(4), "qy": e(5), "qz": e(6), "s0": 0.6 + F.abs(e(7)), "s1": 0.6 + F.abs(e(8)), "s2": F.lit(0.8), "alpha": F.lit(0.8)}
    return vectors(spark, sf).select(F.col("vec_id").alias("stable_id"), *[c.alias(n) for n, c in at.items()])


@query("F822_opacity_field", BLOBS + " SELECT ix, iy, iz, round(density, 6)::DOUBLE AS density FROM field", "vectors")
def f822(spark, sf):  # noqa: ANN001, ANN201
    return V.splat(_blobs(spark, sf), 1.0).select("ix", "iy", "iz", r(F.col("density"), "density"))


def _surface_sql(level: float) -> str:
    corner = lambda k: f"coalesce(max(density) FILTER (k = {k}), 0) AS d{k}"
    every = ", ".join(f"d{k}" for k in range(8))
    cell = f"cell AS (SELECT ix - (k & 1) AS cx, iy - ((k >> 1) & 1) AS cy, iz - (k >> 2) AS cz, {', '.join(corner(k) for k in range(8))} FROM field, range(8) t(k) GROUP BY 1, 2, 3), live AS (SELECT * FROM cell WHERE greatest({every}) >= {level} AND least({every}) < {level})"
    means = []
    for a in range(3):
        parts = [f"CASE WHEN (d{p} >= {level}) != (d{q} >= {level}) THEN {float(p >> a & 1) if (p >> a & 1) == (q >> a & 1) else f'({level} - d{p}) / (d{q} - d{p})'} END" for p, q in V.EDGES]
        means.append(f"list_avg([{', '.join(parts)}])")
    return BLOBS + f", {cell} SELECT " + ", ".join(f"round(c{n} + 0.5 + {m}, 5)::DOUBLE AS {n}" for n, m in zip("xyz", means)) + " FROM live"


@query("F822_surface", _surface_sql(0.4), "vectors")
def f822_surface(spark, sf):  # noqa: ANN001, ANN201
    vertices, _ = V.surface(V.splat(_blobs(spark, sf), 1.0), 1.0, 0.4)
    return vertices.select(*[(F.round(a, 5) + 0.0).alias(a) for a in "xyz"])
