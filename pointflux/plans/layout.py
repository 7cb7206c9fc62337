"""Ordering, sampling, top-k and set operations (F501 to F510)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import layout as Y
from ..operators import sampling as S
from .base import keys, points, query, read
from .sampling import SEGMENTS, _segments, r

C10 = "greatest(0, least(1023, floor(({v} - ({c} - {h})) * 1023 / (2 * {h}) + 0.5)))::BIGINT"
SPREAD = " + ".join(f"((({{v}} >> {i}) & 1) << {3 * i})" for i in range(10))


def _code_sql() -> str:
    parts = [SPREAD.format(v=C10.format(v=v, c=c, h="1500.0")) for v, c in (("x", "250.0"), ("y", "700.0"), ("z", "1200.0"))]
    return f"(({parts[0]}) + (({parts[1]}) << 1) + (({parts[2]}) << 2))::BIGINT"


CODE = _code_sql()


def _coded(spark, sf):  # noqa: ANN001, ANN202
    return points(spark, sf).withColumn("code", Y.morton_of(F.col("x"), F.col("y"), F.col("z"), (250.0, 700.0, 1200.0), 1500.0))


@query("F501_morton_code", f"SELECT stable_id, {CODE} AS code FROM points", "points")
def f501(spark, sf):  # noqa: ANN001, ANN201
    return _coded(spark, sf).select("stable_id", "code")


@query("F502_morton_layout", f"SELECT stable_id, row_number() OVER (ORDER BY {CODE}, segment_id, stable_id) - 1 AS dense_id FROM points", "points")
def f502(spark, sf):  # noqa: ANN001, ANN201
    rows = _coded(spark, sf).select("stable_id", "code", F.col("segment_id").alias("birth"), F.col("stable_id").alias("track"))
    return Y.morton_layout(rows).select("stable_id", "dense_id")


@query("F503_visibility_topk", "MORE s AS (SELECT stable_id, round(1 / (1 + exp(-opacity)) * exp(greatest(-16.0, least(2.0, w / 10)) + greatest(-16.0, least(2.0, mu / 20)) + greatest(-16.0, least(2.0, x / 1000)) - least(greatest(-16.0, least(2.0, w / 10)), greatest(-16.0, least(2.0, mu / 20)), greatest(-16.0, least(2.0, x / 1000)))), 6) AS score FROM points) SELECT stable_id, score FROM s ORDER BY score DESC, stable_id LIMIT (SELECT floor(count(*) * 0.1 + 0.5)::BIGINT FROM points)", "points")
def f503(spark, sf):  # noqa: ANN001, ANN201
    score = Y.visibility(F.col("opacity"), F.col("w") / 10, F.col("mu") / 20, F.col("x") / 1000)
    return Y.top_fraction(points(spark, sf).select("stable_id", r(score, "score")), "score", 0.1, "stable_id")


@query("F504_even_sample", "MORE n AS (SELECT count(*) AS n FROM points), i AS (SELECT floor((i + 0.5) * n / 700)::BIGINT AS pos FROM n, (SELECT unnest(range(700)) AS i)) SELECT stable_id FROM points WHERE stable_id IN (SELECT pos FROM i)", "points")
def f504(spark, sf):  # noqa: ANN001, ANN201
    p = points(spark, sf)
    return Y.even_sample(p.select("stable_id"), "stable_id", p.count(), 700)


@query("F505_stratified_preview", """MORE n AS (SELECT count(*) AS n FROM points), i AS (SELECT floor((i + 0.5) * n / 500)::BIGINT AS pos FROM n, (SELECT unnest(range(500)) AS i)),
u AS (SELECT pos AS stable_id FROM i UNION SELECT * FROM (SELECT stable_id FROM points ORDER BY x, stable_id LIMIT 1) UNION SELECT * FROM (SELECT stable_id FROM points ORDER BY x DESC, stable_id LIMIT 1) UNION SELECT * FROM (SELECT stable_id FROM points ORDER BY y, stable_id LIMIT 1)
UNION SELECT * FROM (SELECT stable_id FROM points ORDER BY y DESC, stable_id LIMIT 1) UNION SELECT * FROM (SELECT stable_id FROM points ORDER BY z, stable_id LIMIT 1) UNION SELECT * FROM (SELECT stable_id FROM points ORDER BY z DESC, stable_id LIMIT 1)) SELECT stable_id FROM u""", "points")
def f505(spark, sf):  # noqa: ANN001, ANN201
    p = points(spark, sf).select("stable_id", "x", "y", "z")
    return Y.preview(p, "stable_id", p.count(), 500).select("stable_id")


@query("F506_segment_order", f"SELECT file_index::INTEGER AS file_index, (row_number() OVER (ORDER BY first_frame) - 1)::INTEGER AS position, first_frame::INTEGER AS first_frame, last_frame::INTEGER AS last_frame FROM {SEGMENTS}")
def f506(spark, sf):  # noqa: ANN001, ANN201
    return S.order_segments(_segments(spark)).select("file_index", "position", "first_frame", "last_frame")


@query("F507_focus_depth", "MORE a AS (SELECT x AS depth, abs(y - 700) / x AS err, stable_id FROM points WHERE x > 1), k AS (SELECT depth FROM a ORDER BY err, stable_id LIMIT (SELECT greatest(16, least(512, floor(count(*) * 0.01)::BIGINT)) FROM a)) SELECT round(median(depth), 6) AS focus FROM k", "points")
def f507(spark, sf):  # noqa: ANN001, ANN201
    rows = points(spark, sf).where("x > 1").select("stable_id", F.col("x").alias("depth"), (F.abs(F.col("y") - 700) / F.col("x")).alias("err"))
    k = max(16, min(512, int(rows.count() * 0.01)))
    return rows.orderBy("err", "stable_id").limit(k).agg(r(F.median("depth"), "focus"))


@query("F508_block_ranges", "SELECT (stable_id // 256)::BIGINT AS block, min(stable_id) AS first_slot, max(stable_id) AS last_slot, count(*) AS n FROM points GROUP BY 1", "points")
def f508(spark, sf):  # noqa: ANN001, ANN201
    return Y.blocks(points(spark, sf), "stable_id")


@query("F509_importance_tiers", "MORE q AS (SELECT stable_id, row_number() OVER (ORDER BY x DESC, stable_id) - 1 AS rank, count(*) OVER () AS n FROM points) SELECT stable_id, ((rank >= floor(n * 0.1 + 0.5))::INTEGER + (rank >= floor(n * 0.4 + 0.5))::INTEGER)::INTEGER AS tier FROM q", "points")
def f509(spark, sf):  # noqa: ANN001, ANN201
    return Y.tiers(points(spark, sf).select("stable_id", "x"), "x", "stable_id", (0.1, 0.4)).select("stable_id", "tier")


@query("F510_set_operations", "SELECT track, frame FROM keys WHERE track % 2 = 0 UNION SELECT track, frame FROM keys WHERE track % 3 = 0 EXCEPT SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'F'", "keys")
def f510(spark, sf):  # noqa: ANN001, ANN201
    k = keys(spark, sf).select("track", "frame")
    gone = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("track"), F.lit(0).alias("frame"))
    return k.where("track % 2 = 0").unionByName(k.where("track % 3 = 0")).dropDuplicates().join(gone, ["track", "frame"], "left_anti")
