"""Encodings along tracks (F601 to F615)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import temporal as T
from .base import keys, query, signal, vectors
from .sampling import r

LAG = "lag({v}) OVER (PARTITION BY track ORDER BY k)"


@query("F601_xor_chain", "SELECT track, k, xor(v16, coalesce(" + LAG.format(v="v16") + ", 0))::INTEGER AS code FROM keys", "keys")
def f601(spark, sf):  # noqa: ANN001, ANN201
    return T.xor_chain(keys(spark, sf), "v16").select("track", "k", "code")


@query("F602_decode_chains", "SELECT track, k, v16 AS from_xor, v16 AS from_delta FROM keys", "keys")
def f602(spark, sf):  # noqa: ANN001, ANN201
    x = T.xor_unchain(T.xor_chain(keys(spark, sf), "v16")).select("track", "k", F.col("decoded").alias("from_xor"))
    d = T.undelta16(T.delta16(keys(spark, sf), "v16")).select("track", "k", F.col("decoded").alias("from_delta"))
    return x.join(d, ["track", "k"])


@query("F603_delta_zigzag", "MORE d AS (SELECT track, k, (v16 - coalesce(" + LAG.format(v="v16") + ", 0) + 32768 + 65536 * 4) % 65536 - 32768 AS delta FROM keys) SELECT track, k, delta::INTEGER AS delta, CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END::INTEGER AS zigzag FROM d", "keys")
def f603(spark, sf):  # noqa: ANN001, ANN201
    return T.delta16(keys(spark, sf), "v16").select("track", "k", "delta", F.col("zigzag").cast("int").alias("zigzag"))


@query("F604_temporal_residuals", """MORE e AS (SELECT track, min(k) AS ka, max(k) AS kb, arg_min(v, k) AS a, arg_max(v, k) AS b FROM keys GROUP BY 1)
SELECT track, k, CASE WHEN k = ka THEN 'birth' WHEN k = kb THEN 'endpoint' ELSE 'internal' END AS kind,
CAST(CASE WHEN k = ka THEN v WHEN k = kb THEN v - a ELSE v - floor(a + (b - a)::DOUBLE * ((k - ka)::DOUBLE / nullif(kb - ka, 0)) + 0.5) END AS BIGINT) AS residual FROM keys JOIN e USING (track)""", "keys")
def f604(spark, sf):  # noqa: ANN001, ANN201
    return T.residuals(keys(spark, sf), "v").select("track", "k", "kind", "residual")


@query("F605_position_lifting", """MORE m AS (SELECT track, k, floor(x / 10)::BIGINT AS cell, v - """ + LAG.format(v="v") + """ AS delta FROM keys), g AS (SELECT floor(avg(delta) + 0.5) AS g FROM m WHERE delta IS NOT NULL),
c AS (SELECT cell, floor(avg(delta - g) + 0.5) AS c FROM m, g WHERE delta IS NOT NULL GROUP BY 1) SELECT track, k, delta, CAST(delta - g - c AS BIGINT) AS residual FROM m JOIN c USING (cell), g WHERE delta IS NOT NULL""", "keys")
def f605(spark, sf):  # noqa: ANN001, ANN201
    return T.lifting(keys(spark, sf), "v", F.floor(F.col("x") / 10)).select("track", "k", "delta", "residual")


@query("F606_so3_chain")
def f606(spark, sf):  # noqa: ANN001, ANN201
    """Each track's 32 rotations; a closed loop has no SQL form, tests decode the codes again."""
    e = lambda i: F.get("e", F.lit(i))
    rows = vectors(spark, sf).select(F.floor(F.col("vec_id") / 32).alias("track"), F.col("vec_id").alias("k"), *[e(i).alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))])
    return T.so3_chain(rows)


@query("F607_ordered_half_chain", "MORE o AS (SELECT track, k, CASE WHEN v16 >= 32768 THEN 65535 - v16 ELSE v16 + 32768 END AS c FROM keys) SELECT track, k, ((c - coalesce(" + LAG.format(v="c") + ", 0) + 65536) % 65536)::INTEGER AS code FROM o", "keys")
def f607(spark, sf):  # noqa: ANN001, ANN201
    rows = keys(spark, sf).withColumn("o", B.ordered_half(F.col("v16")))
    return T.delta16(rows, "o").select("track", "k", F.col("delta").bitwiseAND(0xFFFF).alias("code"))


@query("F608_rq_transform", """MORE s AS (SELECT track, floor(frame / 24)::BIGINT AS segment, frame, code FROM signal), e AS (SELECT track, segment, arg_min(code, frame) AS a, arg_max(code, frame) AS b, min(frame) AS ka, max(frame) AS kb FROM s GROUP BY 1, 2),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY track ORDER BY segment), 0) AS p FROM e)
SELECT track, segment, round(frame, 6) AS frame, round(CASE WHEN frame = ka THEN code - p WHEN frame = kb THEN code - a ELSE code - (a + (b - a) * ((frame - ka) / nullif(kb - ka, 0))) END, 4)::DOUBLE AS residual FROM s JOIN p USING (track, segment)""", "signal")
def f608(spark, sf):  # noqa: ANN001, ANN201
    rows = signal(spark, sf).withColumn("segment", F.floor(F.col("frame") / 24))
    return T.rq_transform(rows, "code", "track", "frame").select("track", "segment", r(F.col("frame"), "frame"), (F.round("residual", 4) + 0.0).alias("residual"))


@query("F609_label_changes", "MORE c AS (SELECT track, event_id, event_type, lag(event_type) OVER (PARTITION BY track ORDER BY event_id) AS p FROM signal) SELECT track, event_id, event_type FROM c WHERE p IS NULL OR p != event_type", "signal")
def f609(spark, sf):  # noqa: ANN001, ANN201
    return T.changes(signal(spark, sf), "event_type", "track", "event_id").where("changed").select("track", "event_id", "event_type")


@query("F610_thresholded_updates", """MORE RECURSIVE n AS MATERIALIZED (SELECT track, event_id, value, row_number() OVER (PARTITION BY track ORDER BY event_id) AS i FROM signal),
u AS (SELECT track, i, value AS last, true AS new FROM n WHERE i = 1 UNION ALL SELECT n.track, n.i, CASE WHEN abs(n.value - u.last) > 25.0 THEN n.value ELSE u.last END, abs(n.value - u.last) > 25.0 FROM u JOIN n ON n.track = u.track AND n.i = u.i + 1)
SELECT n.track, n.event_id, n.value FROM u JOIN n USING (track, i) WHERE u.new""", "signal")
def f610(spark, sf):  # noqa: ANN001, ANN201
    return T.thresholded_updates(signal(spark, sf), "value", 25.0, "track", "event_id")


@query("F611_rice_modes", "MORE b AS (SELECT (track // 8)::BIGINT AS block, track * 8 + k AS k, v FROM keys), p AS (SELECT block, v, coalesce(lag(v, 1) OVER w, 0) AS p1, coalesce(lag(v, 2) OVER w, 0) AS p2, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE first_value(v) OVER w END AS f FROM b WINDOW w AS (PARTITION BY block ORDER BY k)),"
       " m AS (SELECT block, '0 raw' AS mode, v AS r FROM p UNION ALL SELECT block, '1 first', v - p1 FROM p UNION ALL SELECT block, '2 second', v - 2 * p1 + p2 FROM p UNION ALL SELECT block, '3 anchor', v - f FROM p),"
       " z AS (SELECT block, mode, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS u FROM m), c AS (SELECT block, mode, j::INTEGER AS rice, CAST(sum((u >> j) + 1 + j) AS BIGINT) AS bits FROM z, (SELECT unnest(range(21)) AS j) GROUP BY 1, 2, 3)"
       " SELECT block, mode, rice, bits FROM c QUALIFY row_number() OVER (PARTITION BY block ORDER BY bits, mode, rice) = 1", "keys")
def f611(spark, sf):  # noqa: ANN001, ANN201
    rows = keys(spark, sf).select(F.floor(F.col("track") / 8).alias("block"), (F.col("track") * 8 + F.col("k")).alias("k"), "v")
    return T.rice_modes(rows, "v", "block", "k")


#: Keys by their place in the track, and of each pair of places the largest distance of the keys between from their line.
SPANS = """MORE n AS MATERIALIZED (SELECT track, frame, x, y, z, row_number() OVER (PARTITION BY track ORDER BY frame) AS i, count(*) OVER (PARTITION BY track) AS n FROM keys),
p AS (SELECT l.track, l.i, r.i AS j, m.i AS m, l.x + (r.x - l.x) * (m.frame - l.frame) / (r.frame - l.frame) - m.x AS ex, l.y + (r.y - l.y) * (m.frame - l.frame) / (r.frame - l.frame) - m.y AS ey, l.z + (r.z - l.z) * (m.frame - l.frame) / (r.frame - l.frame) - m.z AS ez
  FROM n l JOIN n r ON r.track = l.track AND r.i > l.i LEFT JOIN n m ON m.track = l.track AND m.i > l.i AND m.i < r.i)"""


@query("F612_fewest_knots", SPANS.replace("MORE n", "MORE RECURSIVE n", 1) + """, e AS MATERIALIZED (SELECT track, i, j FROM p GROUP BY ALL HAVING coalesce(max(sqrt(ex * ex + ey * ey + ez * ez)), 0) <= 9),
w AS (SELECT track, 1 AS at, 1 AS steps FROM (SELECT DISTINCT track FROM n) UNION SELECT w.track, e.j, w.steps + 1 FROM w JOIN e ON e.track = w.track AND e.i = w.at),
s AS (SELECT a.track, max(sqrt((a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2)) <= 9 AS still FROM n a JOIN n b ON b.track = a.track AND b.i = 1 GROUP BY 1)
SELECT t.track, t.n::INTEGER AS n_keys, CASE WHEN s.still THEN 1 ELSE min(w.steps) END::INTEGER AS n_kept FROM (SELECT DISTINCT track, n FROM n) t JOIN s USING (track) JOIN w ON w.track = t.track AND w.at = t.n GROUP BY t.track, t.n, s.still""", "keys")
def f612(spark, sf):  # noqa: ANN001, ANN201
    return T.knots(keys(spark, sf), ["x", "y", "z"], 9.0, "fewest", hard=30.0).select("track", "n_keys", "n_kept")


@query("F613_simplify", SPANS.replace("MORE n", "MORE RECURSIVE n", 1) + """, b AS MATERIALIZED (SELECT track, i, j, arg_min(m, m) FILTER (abs(ex) >= top - 1e-12 AND abs(ex) > 5) AS m FROM (SELECT *, max(abs(ex)) OVER (PARTITION BY track, i, j) AS top FROM p) GROUP BY ALL),
g AS (SELECT track, 1::BIGINT AS i, max(i) AS j FROM n GROUP BY 1 UNION ALL SELECT g.track, unnest([g.i, b.m]), unnest([b.m, g.j]) FROM g JOIN b ON b.track = g.track AND b.i = g.i AND b.j = g.j WHERE b.m IS NOT NULL),
s AS (SELECT a.track, count(*) AS n, max(abs(a.x - b.x)) <= 5 AND count(*) > 1 AS still FROM n a JOIN n b ON b.track = a.track AND b.i = 1 GROUP BY 1), k AS (SELECT track, count(DISTINCT u) AS kept FROM (SELECT track, unnest([i, j]) AS u FROM g) GROUP BY 1)
SELECT track, s.n::INTEGER AS n_keys, CASE WHEN still THEN 1 ELSE kept END::INTEGER AS n_kept FROM s JOIN k USING (track)""", "keys")
def f613(spark, sf):  # noqa: ANN001, ANN201
    return T.knots(keys(spark, sf), "x", 5.0, "simplify").select("track", "n_keys", "n_kept")


@query("F614_keep_first", "SELECT track, k, v - first_value(v) OVER (PARTITION BY track ORDER BY k) AS residual FROM keys", "keys")
def f614(spark, sf):  # noqa: ANN001, ANN201
    return T.keep_first(keys(spark, sf), "v").select("track", "k", "residual")


TURNS = ", ".join(f"({i}, {w!r}::DOUBLE, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, (w, x, y, z) in enumerate(T.cube_turns()))


@query("F615_context_predictor", f"""MORE t(s, w, x, y, z) AS (VALUES {TURNS}), q AS (SELECT vec_id // 8 AS track, vec_id % 8 AS k, e[1] / n AS w, e[2] / n AS x, e[3] / n AS y, e[4] / n AS z FROM (SELECT *, sqrt(e[1]**2 + e[2]**2 + e[3]**2 + e[4]**2) AS n FROM vectors)),
f AS (SELECT *, first_value(w) OVER o AS fw, first_value(x) OVER o AS fx, first_value(y) OVER o AS fy, first_value(z) OVER o AS fz FROM q WINDOW o AS (PARTITION BY track ORDER BY k)),
c AS (SELECT track, k, s, abs((f.w*t.w - f.x*t.x - f.y*t.y - f.z*t.z) * fw + (f.w*t.x + f.x*t.w + f.y*t.z - f.z*t.y) * fx + (f.w*t.y - f.x*t.z + f.y*t.w + f.z*t.x) * fy + (f.w*t.z + f.x*t.y - f.y*t.x + f.z*t.w) * fz) AS d FROM f, t)
SELECT track, k, min(s) FILTER (d >= top - 1e-9)::INTEGER AS symmetry, round(max(d), 6)::DOUBLE AS closeness FROM (SELECT *, max(d) OVER (PARTITION BY track, k) AS top FROM c) GROUP BY 1, 2""", "vectors")
def f615(spark, sf):  # noqa: ANN001, ANN201
    e = lambda i: F.get("e", F.lit(i))
    n = F.sqrt(e(0) ** 2 + e(1) ** 2 + e(2) ** 2 + e(3) ** 2)
    rows = vectors(spark, sf).select(F.floor(F.col("vec_id") / 8).alias("track"), (F.col("vec_id") % 8).alias("k"), *[(e(i) / n).alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz"))])
    return T.continuous_symmetry(rows).select("track", "k", "symmetry", r(F.col("closeness"), "closeness"))
