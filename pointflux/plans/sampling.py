"""Point-in-time sampling (F101 to F117)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import quaternion as Q
from ..operators import sampling as S
from .base import keys, points, query, read, signal, vectors

#: Digits that results keep: sums and library functions differ in the last ones.
R = 6


def r(c, name: str):  # noqa: ANN001, ANN201
    """Rounded, with negative zero made zero."""
    return (F.round(c, R) + 0.0).alias(name)


@query("F101_canonical_keyframes", """
SELECT p_partkey AS part, list_aggregate(ks, 'count')::BIGINT AS n_keys, list_aggregate(ks, 'sum')::BIGINT AS sum_keys, ks[-1]::BIGINT AS last_key FROM (
  SELECT p_partkey, CASE WHEN list_contains(s, p_size - 1) THEN s ELSE list_append(s, p_size - 1) END AS ks FROM (
    SELECT p_partkey, p_size, range(0, p_size, (p_partkey % 5 + 1)::INTEGER) AS s FROM part))""")
def f101(spark, sf):  # noqa: ANN001, ANN201
    ks = S.canonical_keyframes(F.col("p_size"), F.col("p_partkey") % 5 + 1)
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("part"), ks.alias("ks"))
    return rows.select("part", F.size("ks").cast("long").alias("n_keys"), F.aggregate("ks", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_keys"), F.element_at("ks", -1).cast("long").alias("last_key"))


AT = 361.25
BRACKET = f"""MORE b AS (SELECT track,
  max(frame) FILTER (frame <= {AT}) AS lf0, arg_max(value, frame) FILTER (frame <= {AT}) AS lv0,
  min(frame) FILTER (frame >= {AT}) AS rf0, arg_min(value, frame) FILTER (frame >= {AT}) AS rv0 FROM signal GROUP BY track),
c AS (SELECT track, coalesce(lf0, rf0) AS lf, CASE WHEN lf0 IS NULL THEN rv0 ELSE lv0 END AS lv, coalesce(rf0, lf0) AS rf, CASE WHEN rf0 IS NULL THEN lv0 ELSE rv0 END AS rv FROM b),
d AS (SELECT *, CASE WHEN rf = lf THEN 0.0 ELSE greatest(0.0, least(1.0, ({AT} - lf) / nullif(rf - lf, 0.0))) END::DOUBLE AS alpha FROM c)
"""


@query("F102_track_span", BRACKET + "SELECT track, round(lf, 6) AS left_frame, round(rf, 6) AS right_frame, round(alpha, 6) AS alpha FROM d", "signal")
def f102(spark, sf):  # noqa: ANN001, ANN201
    b = S.bracket(signal(spark, sf), F.lit(AT))
    return b.select("track", r(F.col("lf"), "left_frame"), r(F.col("rf"), "right_frame"), r(N.span_alpha(F.lit(AT), F.col("lf"), F.col("rf")), "alpha"))


@query("F103_linear_sample", BRACKET + "SELECT track, round(lv + (rv - lv) * alpha, 6) AS value FROM d", "signal")
def f103(spark, sf):  # noqa: ANN001, ANN201
    return S.sample_linear(signal(spark, sf), F.lit(AT)).select("track", r(F.col("value"), "value"))


ABSENT = """MORE s2 AS (SELECT track, frame, CASE WHEN event_type = 'error' THEN '-inf'::DOUBLE ELSE value END AS value FROM signal),
""" + BRACKET.replace("MORE ", "").replace("FROM signal", "FROM s2")


@query("F104_extended_sample", ABSENT + """, o AS (SELECT track, CASE WHEN alpha <= 0 OR lv = rv THEN lv WHEN alpha >= 1 THEN rv
  WHEN lv = '-inf'::DOUBLE OR rv = '-inf'::DOUBLE THEN '-inf'::DOUBLE ELSE lv + (rv - lv) * alpha END AS v FROM d)
SELECT track, v = '-inf'::DOUBLE AS absent, CASE WHEN v = '-inf'::DOUBLE THEN 0.0 ELSE round(v, 6) END::DOUBLE AS value FROM o""", "signal")
def f104(spark, sf):  # noqa: ANN001, ANN201
    rows = signal(spark, sf).withColumn("value", F.when(F.col("event_type") == "error", F.lit(N.NEG_INF)).otherwise(F.col("value")))
    out = S.sample_linear(rows, F.lit(AT), extended=True)
    gone = F.col("value") == N.NEG_INF
    return out.select("track", gone.alias("absent"), F.when(gone, 0.0).otherwise(F.round("value", R) + 0.0).alias("value"))


@query("F105_scale_sample", BRACKET + "SELECT track, round(exp((lv + (rv - lv) * alpha) / 100), 6) AS scale FROM d", "signal")
def f105(spark, sf):  # noqa: ANN001, ANN201
    return S.sample_linear(signal(spark, sf), F.lit(AT)).select("track", r(F.exp(F.col("value") / 100), "scale"))


SIG = "(1.0 / (1.0 + exp(-({}))))"
GATE = "(1.0 / (1.0 + exp(-(10.0 * ({f} - (mu - w)))))) * (1.0 / (1.0 + exp(-(10.0 * ((mu + w) - {f})))))"
OPACITY = f"(1.0 / (1.0 + exp(-opacity))) * {GATE}"


@query("F106_opacity_sample", f"SELECT stable_id, round({OPACITY.format(f='12.5')}, 6) AS gated, round(1.0 / (1.0 + exp(-opacity)), 6) AS baked FROM points", "points")
def f106(spark, sf):  # noqa: ANN001, ANN201
    at, args = F.lit(12.5), (F.col("opacity"), F.col("mu"), F.col("w"))
    return points(spark, sf).select("stable_id", r(S.opacity(at, *args), "gated"), r(S.opacity(at, *args, baked=True), "baked"))


@query("F107_endpoint_timing", """SELECT stable_id, round(CASE WHEN w2 > 0 THEN greatest(0.0, least(1.0, (12.5 - (mu - w2)) / nullif(2 * w2, 0))) ELSE 0.0 END, 6)::DOUBLE AS alpha,
round(x + (y - x) * CASE WHEN w2 > 0 THEN greatest(0.0, least(1.0, (12.5 - (mu - w2)) / nullif(2 * w2, 0))) ELSE 0.0 END, 3)::DOUBLE AS position
FROM (SELECT *, w - 2.5 AS w2 FROM points)""", "points")
def f107(spark, sf):  # noqa: ANN001, ANN201
    alpha = N.endpoint_alpha(F.lit(12.5), F.col("mu"), F.col("w") - 2.5)
    return points(spark, sf).select("stable_id", r(alpha, "alpha"), (F.round(N.lerp(F.col("x"), F.col("y"), alpha), 3) + 0.0).alias("position"))


def _slerp_sql(straight: str, zero_right: str) -> str:
    """Two quaternions a vector: components 1-4 and 5-8; every fifth vector has a zero right end."""
    return f"""MORE a AS (SELECT vec_id, e[1] AS lw, e[2] AS lx, e[3] AS ly, e[4] AS lz,
  CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE e[5] END AS rw, CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE e[6] END AS rx,
  CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE e[7] END AS ry, CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE e[8] END AS rz FROM vectors),
b AS (SELECT vec_id, lw / ln AS lw, lx / ln AS lx, ly / ln AS ly, lz / ln AS lz, {zero_right} FROM (SELECT *, sqrt(lw*lw+lx*lx+ly*ly+lz*lz) AS ln, sqrt(rw*rw+rx*rx+ry*ry+rz*rz) AS rn FROM a)),
c AS (SELECT *, lw*rw+lx*rx+ly*ry+lz*rz AS d0 FROM b),
d AS (SELECT *, CASE WHEN d0 < 0 THEN -1.0 ELSE 1.0 END AS sg, least(1.0, abs(d0)) AS d FROM c),
f AS (SELECT *, acos(d) AS th, sin(acos(d)) AS s FROM d),
g AS (SELECT *, CASE WHEN {straight} THEN 0.7 ELSE sin(0.7 * th) / nullif(s, 0) END AS fa, (CASE WHEN {straight} THEN 0.3 ELSE sin(0.3 * th) / nullif(s, 0) END) * sg AS fb FROM f),
h AS (SELECT vec_id, lw*fa+rw*fb AS w, lx*fa+rx*fb AS x, ly*fa+ry*fb AS y, lz*fa+rz*fb AS z FROM g)
SELECT vec_id, round(w / n, 6) AS qw, round(x / n, 6) AS qx, round(y / n, 6) AS qy, round(z / n, 6) AS qz FROM (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS n FROM h)"""


def _ends(spark, sf):  # noqa: ANN001, ANN202
    e = F.transform("embedding", lambda v: v.cast("double"))
    part = lambda i: F.get("e", F.lit(i))
    zero = F.col("vec_id") % 5 == 0
    rows = read(spark, sf, "embeddings").select("vec_id", F.slice(e, 1, 8).alias("e"))
    return rows, Q.quat(*[part(i) for i in range(4)]), Q.quat(*[F.when(zero, 0.0).otherwise(part(i)) for i in range(4, 8)])


def _quat_out(rows, q):  # noqa: ANN001, ANN202
    return rows.withColumn("q", q).select("vec_id", *[r(F.col(f"q.{n}"), f"q{n}") for n in Q.AXES])


ONE_IF_ZERO = "CASE WHEN rn <= 1e-12 THEN 1.0 ELSE rw / nullif(rn, 0) END AS rw, " + ", ".join(f"CASE WHEN rn <= 1e-12 THEN 0.0 ELSE r{n} / nullif(rn, 0) END AS r{n}" for n in "xyz")
LEFT_IF_ZERO = ", ".join(f"CASE WHEN rn <= 1e-12 THEN l{n} / ln ELSE r{n} / nullif(rn, 0) END AS r{n}" for n in "wxyz")


@query("F108_slerp", _slerp_sql("s <= 1e-5", ONE_IF_ZERO), "vectors")
def f108(spark, sf):  # noqa: ANN001, ANN201
    rows, a, b = _ends(spark, sf)
    return _quat_out(rows, Q.slerp(a, b, F.lit(0.3)))


@query("F109_slerp_export", _slerp_sql("d > 0.9995", LEFT_IF_ZERO), "vectors")
def f109(spark, sf):  # noqa: ANN001, ANN201
    rows, a, b = _ends(spark, sf)
    return _quat_out(rows, Q.slerp_export(a, b, F.lit(0.3)))


LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, {a})) / (1 - greatest(1e-6, least(1 - 1e-6, {a}))))"


@query("F110_alpha_to_logit", f"SELECT stable_id, round({LOGIT.format(a='x / 600')}, 6) AS logit FROM points", "points")
def f110(spark, sf):  # noqa: ANN001, ANN201
    return points(spark, sf).select("stable_id", r(N.logit(F.col("x") / 600), "logit"))


@query("F111_frame_row", f"SELECT stable_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, 0.0::DOUBLE AS nx, round({LOGIT.format(a=OPACITY.format(f='12.0'))}, 4) AS opacity FROM points WHERE NOT deleted", "points")
def f111(spark, sf):  # noqa: ANN001, ANN201
    alpha = S.opacity(F.lit(12.0), F.col("opacity"), F.col("mu"), F.col("w"))
    return points(spark, sf).where("not deleted").select("stable_id", r(F.col("x"), "x"), r(F.col("y"), "y"), r(F.col("z"), "z"), F.lit(0.0).alias("nx"), (F.round(N.logit(alpha), 4) + 0.0).alias("opacity"))


@query("F112_selection_sample", f"SELECT stable_id, round(x, 6) AS x, round({OPACITY.format(f='15.0')}, 6) AS alpha FROM points", "points")
def f112(spark, sf):  # noqa: ANN001, ANN201
    alpha = S.opacity(F.lit(15.0), F.col("opacity"), F.col("mu"), F.col("w"))
    return points(spark, sf).select("stable_id", r(F.col("x"), "x"), r(alpha, "alpha"))


@query("F113_linear_motion", f"""MORE m AS (SELECT stable_id, CAST(CAST(x AS FLOAT)::DOUBLE + CAST(CAST(w AS FLOAT)::DOUBLE * CAST(12.5 - mu AS FLOAT)::DOUBLE AS FLOAT)::DOUBLE AS FLOAT)::DOUBLE AS px,
  greatest(abs(12.5 - mu) - 3.0, 0.0) / greatest(w, 1e-6) AS q, opacity FROM points)
SELECT stable_id, round(px, 4) AS px, round({LOGIT.format(a='(1.0 / (1.0 + exp(-opacity))) * exp(-(q * q))')}, 4) AS logit FROM m""", "points")
def f113(spark, sf):  # noqa: ANN001, ANN201
    at = F.lit(12.5)
    px = S.moving(F.col("x"), F.col("w"), at, F.col("mu"))
    vis = S.visible_logit(F.col("opacity"), at, F.col("mu"), F.col("w"), F.lit(3.0))
    return points(spark, sf).select("stable_id", (F.round(px, 4) + 0.0).alias("px"), (F.round(vis, 4) + 0.0).alias("logit"))


SEGMENTS = "(VALUES (0, 'segment_210_240', 210, 240), (1, 'segment_180_210', 180, 210), (2, 'segment_240_259', 240, 259)) s(file_index, name, first_frame, last_frame)"


def _segments(spark):  # noqa: ANN001, ANN202
    return spark.createDataFrame([(0, "segment_210_240"), (1, "segment_180_210"), (2, "segment_240_259")], "file_index int, name string")


@query("F114_segment_locate", f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY first_frame) - 1 AS pos FROM {SEGMENTS}),
e AS (SELECT event_id, least(greatest(value, 0.0) + 180.0, 259.0) AS src FROM events)
SELECT e.event_id, max(s.pos)::BIGINT AS segment, round(max(src) - max(s.first_frame), 6)::DOUBLE AS local_frame, round(max(src), 6)::DOUBLE AS source_frame FROM e JOIN s ON s.first_frame <= e.src GROUP BY e.event_id""")
def f114(spark, sf):  # noqa: ANN001, ANN201
    ev = read(spark, sf, "events").select("event_id", F.struct("event_id", "value").alias("at"))
    frames = ev.select(F.col("at.value").alias("at"), "event_id")
    segments = S.order_segments(_segments(spark))
    located = S.locate(frames.select("at").distinct(), segments)
    return frames.join(located, "at").select("event_id", F.col("segment").cast("long").alias("segment"), r(F.col("local_frame"), "local_frame"), r(F.col("source_frame"), "source_frame"))


@query("F116_keyframe_requirements", "SELECT at_ AS \"at\", needed FROM (VALUES (0.0::DOUBLE, '0,1'), (5.0::DOUBLE, '0,1,2'), (10.0::DOUBLE, '0,1,2'), (25.0::DOUBLE, '2,3'), (99.0::DOUBLE, '3')) t(at_, needed)")
def f116(spark, sf):  # noqa: ANN001, ANN201
    ks = [0, 10, 20, 30]
    return spark.createDataFrame([(a, ",".join(map(str, S.keyframes_needed(ks, a)))) for a in (0.0, 5.0, 10.0, 25.0, 99.0)], "at double, needed string")


@query("F117_sparse_knots", """MORE f AS (SELECT *, (k % 3 = 1 OR k = max(k) OVER (PARTITION BY track)) AS kept FROM keys),
g AS (SELECT *, last_value(CASE WHEN kept THEN frame END IGNORE NULLS) OVER a AS lf, last_value(CASE WHEN kept THEN x END IGNORE NULLS) OVER a AS lv,
  first_value(CASE WHEN kept THEN frame END IGNORE NULLS) OVER b AS rf, first_value(CASE WHEN kept THEN x END IGNORE NULLS) OVER b AS rv FROM f
  WINDOW a AS (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT track, frame, coalesce(lf, rf) AS lf, coalesce(lv, rv) AS lv, coalesce(rf, lf) AS rf, coalesce(rv, lv) AS rv FROM g)
SELECT track, frame, round(lv + (rv - lv) * CASE WHEN rf = lf THEN 0.0 ELSE greatest(0.0, least(1.0, (frame - lf)::DOUBLE / nullif(rf - lf, 0))) END, 6)::DOUBLE AS rebuilt FROM h""", "keys")
def f117(spark, sf):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    last = F.max("k").over(Window.partitionBy("track"))
    rows = keys(spark, sf).withColumn("kept", (F.col("k") % 3 == 1) | (F.col("k") == last))
    return S.sample_sparse(rows.withColumn("value", F.col("x"))).select("track", "frame", r(F.col("rebuilt"), "rebuilt"))


UNIT = "sqrt(e[{0}]**2 + e[{1}]**2 + e[{2}]**2 + e[{3}]**2)".format(1, 2, 3, 4)


@query("F115_offline_rotations", f"""MORE q AS (SELECT vec_id // 16 AS track, vec_id % 16 AS k, e[1] / {UNIT} AS w, e[2] / {UNIT} AS x, e[3] / {UNIT} AS y, e[4] / {UNIT} AS z FROM vectors),
d AS (SELECT *, coalesce(w * lag(w) OVER o + x * lag(x) OVER o + y * lag(y) OVER o + z * lag(z) OVER o < 0, false)::INTEGER AS t FROM q WINDOW o AS (PARTITION BY track ORDER BY k)),
s AS (SELECT *, CASE WHEN sum(t) OVER (PARTITION BY track ORDER BY k) % 2 = 1 THEN -1 ELSE 1 END AS s FROM d) SELECT track, k, round(s * w, 6)::DOUBLE AS qw, round(s * x, 6)::DOUBLE AS qx, round(s * y, 6)::DOUBLE AS qy, round(s * z, 6)::DOUBLE AS qz FROM s""", "vectors")
def f115(spark, sf):  # noqa: ANN001, ANN201
    e = lambda i: F.get("e", F.lit(i))
    rows = vectors(spark, sf).select(F.floor(F.col("vec_id") / 16).alias("track"), (F.col("vec_id") % 16).alias("k"), *[e(i).alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))])
    return S.offline_rotation_keys(rows).select("track", "k", *[r(F.col(n), n) for n in ("qw", "qx", "qy", "qz")])


@query("F115_offline_sample", """MORE v AS (SELECT track, frame, x, CASE WHEN (track + k) % 5 = 0 THEN '-inf'::DOUBLE ELSE y END AS o FROM keys),
g AS (SELECT track, min(frame) AS f0, max(frame) AS f1, max(frame) FILTER (frame < 20) AS l, min(frame) FILTER (frame >= 20) AS r FROM v GROUP BY 1),
j AS (SELECT g.*, CASE WHEN f0 >= 20 THEN f0 WHEN f1 <= 20 THEN f1 ELSE l END AS a, CASE WHEN f0 >= 20 THEN f0 WHEN f1 <= 20 THEN f1 ELSE r END AS b FROM g)
SELECT j.track, round(CASE WHEN a = b THEN p.x ELSE p.x + (q.x - p.x) * (20 - a) / (b - a) END, 6)::DOUBLE AS x, CASE WHEN isinf(p.o) OR isinf(q.o) THEN NULL ELSE round(CASE WHEN a = b THEN p.o ELSE p.o + (q.o - p.o) * (20 - a) / (b - a) END, 6) END::DOUBLE AS o
FROM j JOIN v p ON p.track = j.track AND p.frame = a JOIN v q ON q.track = j.track AND q.frame = b""", "keys")
def f115_sample(spark, sf):  # noqa: ANN001, ANN201
    o = F.when((F.col("track") + F.col("k")) % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("y"))
    out = S.offline_sample(keys(spark, sf).withColumn("o", o), 20.0, 61, ["x", "o"])
    return out.select("track", r(F.col("x"), "x"), F.when(F.col("o") > float("-inf"), F.round("o", 6) + 0.0).alias("o"))
