"""Aggregations and statistics (F401 to F428)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import quaternion as Q
from ..operators import sampling as S
from ..operators import stats as A
from .base import keys, points, query, read, signal, vectors
from .sampling import OPACITY, r
from .selection import OVER, _sampled

DIST = "sqrt(x * x + y * y + z * z)"


@query("F401_metrics", f"SELECT stable_id, round({OPACITY.format(f='12.0')}, 6) AS opacity, round(greatest(exp(w / 10), exp(mu / 20)), 6) AS scale_max, round(exp(w / 10 + mu / 20), 4) AS volume, round({DIST}, 4) AS distance, mu AS lifetime_center, w AS lifetime_width FROM points", "points")
def f401(spark, sf):  # noqa: ANN001, ANN201
    p = points(spark, sf).withColumn("alpha", S.opacity(F.lit(12.0), F.col("opacity"), F.col("mu"), F.col("w")))
    scale = (F.col("w") / 10, F.col("mu") / 20)
    names = ("opacity", "scale_max", "volume", "distance", "lifetime_center", "lifetime_width")
    digits = {"opacity": 6, "scale_max": 6, "volume": 4, "distance": 4}
    return p.select("stable_id", *[(F.round(A.metric(n, scale), digits[n]) + 0.0 if n in digits else A.metric(n)).alias(n) for n in names])


AGG = OVER + "SELECT stable_id, round(min(alpha * x / 7), 5) AS minimum, round(avg(alpha * x / 7), 5) AS mean, round(max(alpha * x / 7), 5) AS maximum, count(*) AS n FROM a WHERE alpha >= 0.01 GROUP BY 1"


@query("F402_temporal_aggregate", AGG, "points")
def f402(spark, sf):  # noqa: ANN001, ANN201
    out = A.temporal_aggregate(_sampled(spark, sf), F.col("alpha") * F.col("x") / 7, ["stable_id"], visible_only=True)
    return out.select("stable_id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("minimum", "mean", "maximum")], "n")


HIST = """, e AS (SELECT min(v) AS lo, max(v) AS hi FROM g), c AS (SELECT least(47, floor((v - lo) / (hi - lo) * 48))::INTEGER AS bin, count(*) AS n FROM g, e GROUP BY 1)
SELECT b.bin::INTEGER AS bin, round(lo + b.bin * ((hi - lo) / 48), 5) AS low, coalesce(n, 0)::BIGINT AS "count" FROM (SELECT unnest(range(48)) AS bin) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin"""


@query("F403_histogram", OVER + ", g AS (SELECT max(x) AS v FROM a WHERE alpha >= 0.01 AND NOT deleted GROUP BY stable_id)" + HIST, "points")
def f403(spark, sf):  # noqa: ANN001, ANN201
    rows = _sampled(spark, sf).where("not deleted")
    best = A.temporal_aggregate(rows, F.col("x"), ["stable_id"], visible_only=True)
    return A.histogram(best, "maximum").select("bin", (F.round("low", 5) + 0.0).alias("low"), "count")


@query("F404_bounds", "SELECT count(*) FILTER (x IS NULL)::BIGINT AS skipped, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM points", "points")
def f404(spark, sf):  # noqa: ANN001, ANN201
    out = A.bounds(points(spark, sf))
    return out.select("skipped", *[r(F.col(f"{m}_{a}"), f"{m}_{a}") for a in "xyz" for m in ("min", "max")])


@query("F405_support", "SELECT i::INTEGER AS direction, round(max(x * a + y * b + z * c), 5) AS support FROM points, (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for i, (a, b, c) in enumerate(A.DIRECTIONS)) + ") t(i, a, b, c) WHERE NOT deleted GROUP BY i", "points")
def f405(spark, sf):  # noqa: ANN001, ANN201
    return A.support(points(spark, sf).where("not deleted")).select(F.col("direction").cast("int").alias("direction"), (F.round("support", 5) + 0.0).alias("support"))


PLANES = """MORE ax AS (SELECT unnest([-1, 0, 1]) AS c), dir AS (SELECT row_number() OVER (ORDER BY a.c, b.c, d.c) AS i, a.c / sqrt(a.c*a.c + b.c*b.c + d.c*d.c) AS a, b.c / sqrt(a.c*a.c + b.c*b.c + d.c*d.c) AS b, d.c / sqrt(a.c*a.c + b.c*b.c + d.c*d.c) AS c FROM ax a, ax b, ax d WHERE abs(a.c) + abs(b.c) + abs(d.c) > 0),
live AS (SELECT x, y, z FROM points WHERE NOT deleted), box AS (SELECT sqrt((max(x) - min(x))**2 + (max(y) - min(y))**2 + (max(z) - min(z))**2) AS size FROM live),
h AS MATERIALIZED (SELECT i, a, b, c, (SELECT max(x * a + y * b + z * c) FROM live) + (SELECT greatest(1e-5, 0.0015 * size) FROM box) AS h FROM dir),
t AS (SELECT p.i AS i, q.i AS j, r.i AS k, p.a * (q.b * r.c - q.c * r.b) - p.b * (q.a * r.c - q.c * r.a) + p.c * (q.a * r.b - q.b * r.a) AS det,
  p.h * (q.b * r.c - q.c * r.b) - p.b * (q.h * r.c - q.c * r.h) + p.c * (q.h * r.b - q.b * r.h) AS dx, p.a * (q.h * r.c - q.c * r.h) - p.h * (q.a * r.c - q.c * r.a) + p.c * (q.a * r.h - q.h * r.a) AS dy,
  p.a * (q.b * r.h - q.h * r.b) - p.b * (q.a * r.h - q.h * r.a) + p.h * (q.a * r.b - q.b * r.a) AS dz FROM h p JOIN h q ON q.i > p.i JOIN h r ON r.i > q.i),
v AS MATERIALIZED (SELECT dx / det AS x, dy / det AS y, dz / det AS z FROM t WHERE abs(det) > 1e-9), s AS MATERIALIZED (SELECT DISTINCT round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y, round(z, 2) + 0.0 AS z FROM v WHERE NOT EXISTS (SELECT 1 FROM h WHERE v.x * h.a + v.y * h.b + v.z * h.c > h.h + (SELECT size FROM box) * 4e-6)),
f AS (SELECT h.i, count(*) AS n FROM h, s WHERE abs(s.x * h.a + s.y * h.b + s.z * h.c - h.h) < 0.05 GROUP BY 1 HAVING count(*) >= 3)"""


@query("F406_envelope", PLANES + " SELECT x, y, z, (SELECT sum(n - 2) FROM f)::BIGINT AS triangles, (SELECT sum(n) // 2 FROM f)::BIGINT AS edges FROM s", "points")
def f406(spark, sf):  # noqa: ANN001, ANN201
    rows = sorted((x["direction"], x["support"]) for x in A.support(points(spark, sf).where("not deleted")).collect())  # 26 numbers
    vertices, triangles, edges = A.envelope([s for _, s in rows])
    out = spark.createDataFrame([(*v, len(triangles), len(edges)) for v in vertices], "x double, y double, z double, triangles long, edges long")
    return out.select(*[(F.round(a, 2) + 0.0).alias(a) for a in "xyz"], "triangles", "edges")


SICK = """MORE sick AS (SELECT e[1] AS x, CASE WHEN vec_id % 17 = 0 THEN 'nan'::DOUBLE ELSE e[2] END AS y, e[3] AS z, CASE WHEN vec_id % 3 = 0 THEN e[4] / n ELSE e[4] END AS qw,
  CASE WHEN vec_id % 3 = 0 THEN e[5] / n ELSE e[5] END AS qx, CASE WHEN vec_id % 3 = 0 THEN e[6] / n ELSE e[6] END AS qy, CASE WHEN vec_id % 3 = 0 THEN e[7] / n ELSE e[7] END AS qz,
  CASE WHEN vec_id % 13 = 0 THEN 'nan'::DOUBLE ELSE e[8] * 60 END AS scale, CASE WHEN vec_id % 11 = 0 THEN '-inf'::DOUBLE WHEN vec_id % 19 = 0 THEN 'inf'::DOUBLE ELSE e[9] * 100 END AS opacity,
  e[10] AS mu, CASE WHEN vec_id % 23 = 0 THEN -1.0 ELSE abs(e[11]) END AS w FROM (SELECT *, sqrt(e[4]*e[4]+e[5]*e[5]+e[6]*e[6]+e[7]*e[7]) AS n FROM vectors)),
f AS (SELECT *, sqrt(qw*qw+qx*qx+qy*qy+qz*qz) AS len FROM sick)
"""


def sick(spark, sf):  # noqa: ANN001, ANN201
    """Points with faults: broken numbers, lengths and lifetimes."""
    e = lambda i: F.get("e", F.lit(i))
    every = lambda k: F.col("vec_id") % k == 0
    n = F.sqrt(e(3) ** 2 + e(4) ** 2 + e(5) ** 2 + e(6) ** 2)
    rows = vectors(spark, sf).withColumn("n", n)
    nan, inf = float("nan"), float("inf")
    return rows.select(
        "vec_id", e(0).alias("x"), F.when(every(17), nan).otherwise(e(1)).alias("y"), e(2).alias("z"),
        *[F.when(every(3), e(i) / F.col("n")).otherwise(e(i)).alias(q) for i, q in ((3, "qw"), (4, "qx"), (5, "qy"), (6, "qz"))],
        F.when(every(13), nan).otherwise(e(7) * 60).alias("scale"), F.when(every(11), -inf).when(every(19), inf).otherwise(e(8) * 100).alias("opacity"),
        e(9).alias("mu"), F.when(every(23), -1.0).otherwise(F.abs(e(10))).alias("w"),
    )


@query("F407_health_audit", SICK + """SELECT code, "count" FROM (SELECT unnest([
 {'code': 'nonfinite-position', 'count': count(*) FILTER (NOT isfinite(x) OR NOT isfinite(y) OR NOT isfinite(z))}, {'code': 'nonfinite-rotation', 'count': count(*) FILTER (NOT isfinite(len))},
 {'code': 'nonfinite-scale', 'count': count(*) FILTER (NOT isfinite(scale))}, {'code': 'nonfinite-opacity', 'count': count(*) FILTER (isnan(opacity) OR opacity = 'inf'::DOUBLE)},
 {'code': 'quaternion-length', 'count': count(*) FILTER (isfinite(len) AND abs(len - 1) > 0.02)}, {'code': 'scale-range', 'count': count(*) FILTER (isnan(scale) OR scale < -20 OR scale > 10)},
 {'code': 'opacity-range', 'count': count(*) FILTER (isfinite(opacity) AND (opacity < -20 OR opacity > 20))}, {'code': 'lifetime', 'count': count(*) FILTER (NOT isfinite(mu) OR NOT isfinite(w) OR w < 0)}]) AS s FROM f) t, LATERAL (SELECT s.code AS code, s."count" AS "count")""", "vectors")
def f407(spark, sf):  # noqa: ANN001, ANN201
    return A.health(sick(spark, sf))


@query("F408_health_repair", """MORE g AS (SELECT track, k, CASE WHEN k % 3 = 0 THEN NULL ELSE x END AS v FROM keys),
h AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER a AS bk, last_value(v IGNORE NULLS) OVER a AS bv, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS ak, first_value(v IGNORE NULLS) OVER b AS av FROM g
 WINDOW a AS (PARTITION BY track ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY track ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track, k, coalesce(CASE WHEN bk IS NULL THEN av WHEN ak IS NULL THEN bv WHEN k - bk <= ak - k THEN bv ELSE av END, -1.0)::DOUBLE AS x FROM h""", "keys")
def f408(spark, sf):  # noqa: ANN001, ANN201
    broken = keys(spark, sf).select("track", "k", F.when(F.col("k") % 3 == 0, float("nan")).otherwise(F.col("x")).alias("x"))
    return A.repair_keys(broken, "x", -1.0)


@query("F409_report_merge", "SELECT event_type AS code, CAST(sum(event_id % 7) AS BIGINT) AS \"count\", arg_min('label ' || user_id, event_id) AS label, arg_min(CASE WHEN user_id % 2 = 0 THEN 'warning' ELSE 'error' END, event_id) AS severity FROM events GROUP BY 1")
def f409(spark, sf):  # noqa: ANN001, ANN201
    label = F.concat(F.lit("label "), F.col("user_id").cast("string"))
    rows = read(spark, sf, "events").select(F.col("event_type").alias("code"), (F.col("event_id") % 7).alias("count"), label.alias("label"), F.when(F.col("user_id") % 2 == 0, "warning").otherwise("error").alias("severity"), F.col("event_id").alias("report"))
    return A.merge_reports(rows)


@query("F410_invisible_points", "SELECT track FROM keys GROUP BY track HAVING bool_and(y <= 5) AND bool_and(z >= 1)", "keys")
def f410(spark, sf):  # noqa: ANN001, ANN201
    rows = keys(spark, sf).select("track", "frame", F.when(F.col("y") <= 5, float("-inf")).otherwise(0.0).alias("opacity"), (F.col("z") - 1).alias("w"))
    return A.invisible(rows)


@query("F411_shared_state", "SELECT count(*)::BIGINT AS source_state, count(DISTINCT track)::BIGINT AS tracks, count(*) FILTER (changed)::BIGINT AS updates, (count(*) - count(DISTINCT track) - count(*) FILTER (changed))::BIGINT * 48 AS saved_bytes FROM (SELECT track, y != lag(y) OVER (PARTITION BY track ORDER BY k) AS changed FROM keys)", "keys")
def f411(spark, sf):  # noqa: ANN001, ANN201
    from ..operators.temporal import changes

    rows = changes(keys(spark, sf), "y", "track", "k")
    one = rows.agg(F.count(F.lit(1)).alias("source_state"), F.count_if("first").alias("tracks"), F.count_if(F.col("changed") & ~F.col("first")).alias("updates"))
    return one.withColumn("saved_bytes", (F.col("source_state") - F.col("tracks") - F.col("updates")) * 48)


@query("F412_error_stats", """WITH q AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_orderkey * 10 + l_linenumber AS id, l_quantity AS a, CASE WHEN l_orderkey % 3 = 0 THEN l_quantity ELSE l_quantity + l_discount END AS b FROM lineitem)
SELECT flag, status, count(*) AS n, count(*) AS n_finite, count(*) FILTER (a = b) AS n_exact, round(avg(abs(b - a)), 9) AS mae, round(sqrt(avg((b - a) * (b - a))), 9) AS rmse, round(max(abs(b - a)), 9) AS worst FROM q GROUP BY GROUPING SETS ((flag), (status), ())""")
def f412(spark, sf):  # noqa: ANN001, ANN201
    b = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") + F.col("l_discount"))
    rows = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("a"), b.alias("b"))
    out = A.error_stats(rows, "a", "b", ["flag", "status"], "id")
    return out.select("flag", "status", "n", "n_finite", "n_exact", *[(F.round(c, 9) + 0.0).alias(c) for c in ("mae", "rmse", "worst")])


@query("F413_log_histogram", "SELECT CASE WHEN value = 0 THEN -1 ELSE least(279, floor((log10(greatest(value, 1e-12)) + 12) * 20 + 1e-9)) END::INTEGER AS bin, count(*) AS \"count\" FROM signal GROUP BY 1", "signal")
def f413(spark, sf):  # noqa: ANN001, ANN201
    return A.log_histogram(signal(spark, sf), "value")


@query("F413_quantile_bound", "MORE h AS (SELECT CASE WHEN value = 0 THEN -1 ELSE least(279, floor((log10(greatest(value, 1e-12)) + 12) * 20 + 1e-9)) END::INTEGER AS bin, count(*) AS c FROM signal GROUP BY 1), g AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS upto, sum(c) OVER () AS n FROM h) SELECT min(bin) AS bin, round(1e-12 * pow(10.0, (min(bin) + 1) / 20.0), 6)::DOUBLE AS bound FROM g WHERE upto >= ceil(n * 0.95)", "signal")
def f413q(spark, sf):  # noqa: ANN001, ANN201
    return A.quantile_bound(A.log_histogram(signal(spark, sf), "value"), 0.95).select("bin", r(F.col("bound"), "bound"))


SEMANTIC = """MORE a AS (SELECT vec_id, e, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4]) AS n1, sqrt(e[5]*e[5]+e[6]*e[6]+e[7]*e[7]+e[8]*e[8]) AS n2 FROM vectors)
SELECT vec_id, round(sqrt((e[9]-e[12])**2 + (e[10]-e[13])**2 + (e[11]-e[14])**2), 6) AS position_l2,
round(2 * acos(least(1.0, abs(e[1]/n1*(e[5]/n2)+e[2]/n1*(e[6]/n2)+e[3]/n1*(e[7]/n2)+e[4]/n1*(e[8]/n2)))) * 180 / pi(), 5) AS rotation_degrees,
round(abs(exp(e[15] - e[16]) - 1), 6) AS relative_radius, round(abs(e[17] - e[18]) * 0.28209479177387814, 6) AS dc, round(abs(1 / (1 + exp(-e[19])) - 1 / (1 + exp(-e[20]))), 6) AS alpha FROM a"""


@query("F414_semantic_errors", SEMANTIC, "vectors")
def f414(spark, sf):  # noqa: ANN001, ANN201
    e = lambda i: F.get("e", F.lit(i - 1))
    rows = vectors(spark, sf).withColumn("q1", Q.normalize(Q.quat(*[e(i) for i in (1, 2, 3, 4)]))).withColumn("q2", Q.normalize(Q.quat(*[e(i) for i in (5, 6, 7, 8)])))
    return rows.select(
        "vec_id", r(F.sqrt((e(9) - e(12)) ** 2 + (e(10) - e(13)) ** 2 + (e(11) - e(14)) ** 2), "position_l2"), (F.round(Q.angle_degrees(F.col("q1"), F.col("q2")), 5) + 0.0).alias("rotation_degrees"),
        r(F.abs(F.expm1(e(15) - e(16))), "relative_radius"), r(F.abs(e(17) - e(18)) * N.SH_C0, "dc"), r(F.abs(N.sigmoid(e(19)) - N.sigmoid(e(20))), "alpha"),
    )


@query("F415_motion_error", "MORE m AS (SELECT k, abs(x - lag(x) OVER (PARTITION BY track ORDER BY k)) AS speed, abs(y - z) AS err FROM keys) SELECT k, count(*) AS n, round(avg(speed), 6) AS mean_speed, max(speed) AS max_speed, round(sqrt(avg(err * err)), 6) AS rmse, round(coalesce(corr(err, speed), 0), 6) AS pearson FROM m WHERE speed IS NOT NULL GROUP BY k", "keys")
def f415(spark, sf):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    speed = F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("track").orderBy("k")))
    rows = keys(spark, sf).select("k", speed.alias("speed"), F.abs(F.col("y") - F.col("z")).alias("err")).where("speed is not null")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), r(F.avg("speed"), "mean_speed"), F.max("speed").alias("max_speed"), r(F.sqrt(F.avg(F.col("err") ** 2)), "rmse"), r(F.coalesce(F.corr("err", "speed"), F.lit(0.0)), "pearson"))


@query("F416_boundary_gap", """MORE d AS (SELECT track, CAST(floor(frame / 24) AS BIGINT) AS seg, arg_min(value, frame) AS first_v, arg_max(value, frame) AS last_v FROM signal GROUP BY 1, 2)
SELECT a.seg AS segment, count(*) AS shared, round(max(abs(b.first_v - a.last_v)), 6) AS gap FROM d a JOIN d b ON a.track = b.track AND b.seg = a.seg + 1 GROUP BY 1""", "signal")
def f416(spark, sf):  # noqa: ANN001, ANN201
    ends = signal(spark, sf).groupBy("track", F.floor(F.col("frame") / 24).alias("segment")).agg(F.min_by("value", "frame").alias("first_v"), F.max_by("value", "frame").alias("last_v"))
    nxt = ends.select("track", (F.col("segment") - 1).alias("segment"), F.col("first_v").alias("next_v"))
    return ends.join(nxt, ["track", "segment"]).groupBy("segment").agg(F.count(F.lit(1)).alias("shared"), r(F.max(F.abs(F.col("next_v") - F.col("last_v"))), "gap"))


@query("F417_error_quantiles", "SELECT label, round(avg(abs(e[1] - e[2])), 9) AS mae, round(sqrt(avg((e[1] - e[2]) ** 2)), 9) AS rmse, round(quantile_cont(abs(e[1] - e[2]), 0.95), 9) AS p95, round(max(abs(e[1] - e[2])), 9) AS worst FROM vectors GROUP BY 1", "vectors")
def f417(spark, sf):  # noqa: ANN001, ANN201
    err = F.get("e", F.lit(0)) - F.get("e", F.lit(1))
    rows = vectors(spark, sf).select("label", err.alias("d"))
    out = rows.groupBy("label").agg(F.avg(F.abs("d")).alias("mae"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rmse"), F.percentile(F.abs("d"), 0.95).alias("p95"), F.max(F.abs("d")).alias("worst"))
    return out.select("label", *[(F.round(c, 9) + 0.0).alias(c) for c in ("mae", "rmse", "p95", "worst")])


RANK = "MORE n AS (SELECT row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n, x FROM points), p(p) AS (VALUES {}) "


@query("F418_robust_bounds", RANK.format("(0.002::DOUBLE), (0.998::DOUBLE)") + "SELECT p, x AS value FROM n, p WHERE i = floor(p * (n - 1) + 0.5)", "points")
def f418(spark, sf):  # noqa: ANN001, ANN201
    return A.nearest_rank(points(spark, sf), "x", (0.002, 0.998))


@query("F419_robust_centre", RANK.format("(0.005::DOUBLE), (0.995::DOUBLE)") + "SELECT round(avg(x), 6) AS centre FROM n, p WHERE i = floor(p * (n - 1) + 0.5)", "points")
def f419(spark, sf):  # noqa: ANN001, ANN201
    return A.nearest_rank(points(spark, sf), "x", (0.005, 0.995)).agg(r(F.avg("value"), "centre"))


@query("F420_crop_coverage", "MORE t AS (SELECT track, bool_and(x <= 40) AS a, bool_or(x <= 40) AS o, arg_min(x, k) <= 40 AS f FROM keys GROUP BY 1) SELECT count(*) AS tracks, count(*) FILTER (f) AS reference_kept, count(*) FILTER (a) AS all_inside, count(*) FILTER (o) AS any_inside FROM t", "keys")
def f420(spark, sf):  # noqa: ANN001, ANN201
    inside = F.col("x") <= 40
    rows = keys(spark, sf).groupBy("track").agg(F.bool_and(inside).alias("a"), F.bool_or(inside).alias("o"), F.min_by(inside, "k").alias("f"))
    return rows.agg(F.count(F.lit(1)).alias("tracks"), F.count_if("f").alias("reference_kept"), F.count_if("a").alias("all_inside"), F.count_if("o").alias("any_inside"))


@query("F421_entropy", "MORE c AS (SELECT k, v16 // 256 AS s, count(*)::DOUBLE AS c FROM keys GROUP BY 1, 2) SELECT k, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS bits, sum(c)::BIGINT AS n, count(*) AS symbols, min(s)::BIGINT AS lowest, max(s)::BIGINT AS highest FROM c GROUP BY k", "keys")
def f421(spark, sf):  # noqa: ANN001, ANN201
    out = A.entropy(keys(spark, sf), F.floor(F.col("v16") / 256), [F.col("k")])
    return out.select(F.col("_b0").alias("k"), r(F.col("bits"), "bits"), "n", "symbols", "lowest", "highest")


@query("F422_residual_dictionary", "SELECT x, y, z, count(*) AS \"count\" FROM keys GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 254", "keys")
def f422(spark, sf):  # noqa: ANN001, ANN201
    return A.top_symbols(keys(spark, sf), ["x", "y", "z"])


@query("F423_cell_motion", """MORE m AS (SELECT x, y, v16 - lag(v16) OVER (PARTITION BY track ORDER BY k) AS d FROM keys), g AS (SELECT floor(avg(d) + 0.5) AS mean FROM m WHERE d IS NOT NULL)
SELECT floor(x / 5)::BIGINT AS cx, floor(y / 2)::BIGINT AS cy, count(*) AS n, CAST(floor(avg(d - mean) + 0.5) AS BIGINT) AS cell_mean FROM m, g WHERE d IS NOT NULL GROUP BY 1, 2""", "keys")
def f423(spark, sf):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    d = F.col("v16") - F.lag("v16").over(Window.partitionBy("track").orderBy("k"))
    moves = keys(spark, sf).select("x", "y", d.alias("d")).where("d is not null")
    mean = moves.agg(N.js_round(F.avg("d")).alias("mean"))
    cells = moves.crossJoin(F.broadcast(mean)).groupBy(F.floor(F.col("x") / 5).alias("cx"), F.floor(F.col("y") / 2).alias("cy"))
    return cells.agg(F.count(F.lit(1)).alias("n"), N.js_round(F.avg(F.col("d") - F.col("mean"))).cast("long").alias("cell_mean"))


@query("F424_kept_counts", "SELECT segment_id, count(*) FILTER (deleted) AS deleted, count(*) FILTER (NOT deleted) AS kept FROM points GROUP BY 1", "points")
def f424(spark, sf):  # noqa: ANN001, ANN201
    return points(spark, sf).groupBy("segment_id").agg(F.count_if("deleted").alias("deleted"), F.count_if(~F.col("deleted")).alias("kept"))


@query("F425_stream_sizes", "SELECT source AS stream_group, count(*) AS streams, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def f425(spark, sf):  # noqa: ANN001, ANN201
    return read(spark, sf, "documents").groupBy(F.col("source").alias("stream_group")).agg(F.count(F.lit(1)).alias("streams"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("F427_lower_median", "SELECT event_type, quantile_disc(value, 0.5) AS median FROM events GROUP BY 1")
def f427(spark, sf):  # noqa: ANN001, ANN201
    return read(spark, sf, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("median"))
