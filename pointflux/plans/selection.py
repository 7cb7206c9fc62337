"""Predicates, selection and edits (F201 to F221)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import sampling as S
from ..operators import selection as L
from .base import keys, points, query, read
from .sampling import OPACITY, r

RECT = (50.0, 100.0, 300.0, 700.0)
PATH = [(50.0, 100.0), (300.0, 700.0), (450.0, 200.0)]
CORNERS = [(20.0, 50.0), (420.0, 90.0), (250.0, 900.0)]
SAMPLES = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in L.resample_path(PATH, 25.0))


def _crossings() -> tuple[str, str]:
    cuts, near = [], []
    for (ax, ay), (bx, by) in zip(CORNERS, [*CORNERS[1:], CORNERS[0]]):
        dx, dy = bx - ax, by - ay
        cuts.append(f"CASE WHEN (({ay} > y) != ({by} > y)) AND x < {dx}::DOUBLE * (y - {ay}) / {dy} + {ax} THEN 1 ELSE 0 END")
        t = f"greatest(0.0, least(1.0, ((x - {ax}) * {dx} + (y - {ay}) * {dy}) / {dx * dx + dy * dy}::DOUBLE))"
        near.append(f"(x - ({ax} + {t} * {dx})) ** 2 + (y - ({ay} + {t} * {dy})) ** 2 <= 0.5625")
    return " + ".join(cuts), " OR ".join(near)


@query("F201_rect_normalize", "SELECT stable_id, least(x, y) AS low, greatest(x, y) AS high FROM points", "points")
def f201(spark, sf):  # noqa: ANN001, ANN201
    return points(spark, sf).select("stable_id", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))


@query("F202_rect_contains", "SELECT stable_id FROM points WHERE x BETWEEN 50 AND 300 AND y BETWEEN 100 AND 700", "points")
def f202(spark, sf):  # noqa: ANN001, ANN201
    return points(spark, sf).where(L.in_rect(F.col("x"), F.col("y"), L.normalize_rect(300, 700, 50, 100))).select("stable_id")


@query("F203_brush_contains", f"MORE s(sx, sy) AS (VALUES {SAMPLES}) SELECT DISTINCT stable_id FROM points, s WHERE (sx - x) * (sx - x) + (sy - y) * (sy - y) <= 625.0", "points")
def f203(spark, sf):  # noqa: ANN001, ANN201
    return points(spark, sf).where(L.in_brush(F.col("x"), F.col("y"), PATH, 25.0)).select("stable_id")


@query("F204_polygon_contains", "SELECT stable_id FROM points WHERE ({}) % 2 = 1 OR {}".format(*_crossings()), "points")
def f204(spark, sf):  # noqa: ANN001, ANN201
    return points(spark, sf).where(L.in_polygon(F.col("x"), F.col("y"), CORNERS)).select("stable_id")


CYL = "(y >= -5 AND y <= 900 AND (x - 250) * (x - 250) + (z - 1200) * (z - 1200) <= 250000)"


def _cyl():  # noqa: ANN202
    return L.in_cylinder(F.col("x"), F.col("y"), F.col("z"), 250.0, 1200.0, 500.0, 900.0, 5.0)


@query("F205_cylinder_contains", f"SELECT stable_id FROM points WHERE {CYL}", "points")
def f205(spark, sf):  # noqa: ANN001, ANN201
    return points(spark, sf).where(_cyl()).select("stable_id")


@query("F206_project_clip", """MORE p AS (SELECT stable_id, x - 10 AS dx, y - 20 AS dy, z + 5 AS dz FROM points)
SELECT stable_id, round(400 + 500 * dx / dz, 4)::DOUBLE AS sx, round(300 - 500 * dy / dz, 4)::DOUBLE AS sy, dz::DOUBLE AS depth FROM p WHERE dz BETWEEN 100 AND 2000""", "points")
def f206(spark, sf):  # noqa: ANN001, ANN201
    sx, sy, depth = L.project(F.col("x"), F.col("y"), F.col("z"), (10, 20, -5), (1, 0, 0), (0, 1, 0), (0, 0, 1), 500.0, 800.0, 600.0)
    rows = points(spark, sf).select("stable_id", (F.round(sx, 4) + 0.0).alias("sx"), (F.round(sy, 4) + 0.0).alias("sy"), depth.alias("depth"))
    return rows.where(F.col("depth").between(100, 2000))


FRAMES = (5.0, 15.0, 25.0)
OVER = f"MORE f AS (SELECT p.*, t.f FROM points p, (VALUES (5.0::DOUBLE), (15.0::DOUBLE), (25.0::DOUBLE)) t(f)), a AS (SELECT *, {OPACITY.format(f='f')} AS alpha FROM f) "


def _sampled(spark, sf):  # noqa: ANN001, ANN202
    rows = S.over_frames(points(spark, sf), FRAMES)
    return rows.withColumn("alpha", S.opacity(F.col("frame"), F.col("opacity"), F.col("mu"), F.col("w")))


@query("F207_screen_selection", OVER + "SELECT DISTINCT segment_id, stable_id FROM a WHERE alpha >= 0.01 AND NOT deleted AND x BETWEEN 50 AND 300 AND y BETWEEN 100 AND 700", "points")
def f207(spark, sf):  # noqa: ANN001, ANN201
    hit = L.in_rect(F.col("x"), F.col("y"), RECT) & (F.col("alpha") >= L.VISIBLE) & ~F.col("deleted")
    return _sampled(spark, sf).where(hit).select("segment_id", "stable_id").distinct()


@query("F208_cylinder_keep", OVER + f", g AS (SELECT stable_id, deleted, bool_or(alpha >= 0.01 AND NOT deleted AND {CYL}) AS hit, NOT deleted AS eligible FROM a GROUP BY stable_id, deleted)"
       " SELECT stable_id, deleted OR (eligible AND NOT hit) AS gone_inside, deleted OR (eligible AND hit) AS gone_outside FROM g", "points")
def f208(spark, sf):  # noqa: ANN001, ANN201
    seen = (F.col("alpha") >= L.VISIBLE) & ~F.col("deleted") & _cyl()
    rows = _sampled(spark, sf).groupBy("stable_id", "deleted").agg(F.bool_or(seen).alias("hit"))
    inside = L.keep_shape(rows, F.col("hit"), ~F.col("deleted"), True).withColumnRenamed("deleted", "gone_inside")
    outside = L.keep_shape(rows, F.col("hit"), ~F.col("deleted"), False).select(F.col("stable_id").alias("id"), F.col("deleted").alias("gone_outside"))
    return inside.join(outside, F.col("stable_id") == F.col("id")).select("stable_id", "gone_inside", "gone_outside")


@query("F209_histogram_range", "SELECT stable_id FROM points WHERE NOT deleted AND x BETWEEN 100 AND 200", "points")
def f209(spark, sf):  # noqa: ANN001, ANN201
    return points(spark, sf).where(~F.col("deleted") & F.col("x").between(*sorted((200.0, 100.0)))).select("stable_id")


ALGEBRA = """MORE i AS (SELECT o_orderkey % 4 AS segment_id, o_orderkey AS stable_id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
SELECT stable_id, NOT deleted AND coalesce(n, 0) > 0 AS replaced, NOT deleted AND (selected OR coalesce(n, 0) > 0) AS added,
NOT deleted AND (selected AND coalesce(n, 0) = 0) AS removed, NOT deleted AND (selected != (coalesce(n, 0) % 2 = 1)) AS toggled FROM points LEFT JOIN i USING (stable_id)"""


@query("F210_selection_algebra", ALGEBRA, "points")
def f210(spark, sf):  # noqa: ANN001, ANN201
    edits = points(spark, sf).select("segment_id", "stable_id", "deleted", "selected")
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stable_id"))
    ids = lines.where("stable_id % 3 = 0").select((F.col("stable_id") % 4).cast("int").alias("segment_id"), "stable_id").join(edits.select("stable_id"), "stable_id", "left_semi")
    out = edits.select("stable_id")
    for mode, name in (("replace", "replaced"), ("add", "added"), ("remove", "removed"), ("toggle", "toggled")):
        out = out.join(L.select(edits, ids, mode).select("stable_id", F.col("selected").alias(name)), "stable_id")
    return out


@query("F211_modifier_mode", "SELECT * FROM (VALUES ('replace', 0), ('add', 1), ('toggle', 2), ('toggle', 3), ('remove', 4), ('remove', 7)) t(mode, keys)")
def f211(spark, sf):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(L.mode_of(bool(k & 1), bool(k & 2), bool(k & 4)), k) for k in (0, 1, 2, 3, 4, 7)], "mode string, keys int")


@query("F212_invert_selection", "SELECT stable_id, NOT deleted AND NOT selected AS selected FROM points", "points")
def f212(spark, sf):  # noqa: ANN001, ANN201
    return L.invert(points(spark, sf)).select("stable_id", "selected")


@query("F213_soft_delete", "SELECT segment_id, count(*) FILTER (selected AND NOT deleted) AS newly_deleted, count(*) FILTER (deleted OR selected) AS deleted_total FROM points GROUP BY 1", "points")
def f213(spark, sf):  # noqa: ANN001, ANN201
    return L.delete_selected(points(spark, sf)).groupBy("segment_id").agg(F.count_if("newly").alias("newly_deleted"), F.count_if("deleted").alias("deleted_total"))


@query("F214_selected_ids", "SELECT stable_id FROM points WHERE selected AND NOT deleted", "points")
def f214(spark, sf):  # noqa: ANN001, ANN201
    return L.selected_ids(points(spark, sf)).select("stable_id").orderBy("stable_id")


@query("F215_bitset_count", "SELECT segment_id, count(*) FILTER (selected) AS n_selected, count(*) FILTER (deleted) AS n_deleted, count(*) AS n FROM points GROUP BY 1", "points")
def f215(spark, sf):  # noqa: ANN001, ANN201
    bits = points(spark, sf).groupBy("segment_id", F.bitmap_bucket_number("stable_id").alias("b"))
    per = bits.agg(F.bitmap_count(F.bitmap_construct_agg(F.when(F.col("selected"), F.bitmap_bit_position("stable_id")))).alias("s"), F.bitmap_count(F.bitmap_construct_agg(F.when(F.col("deleted"), F.bitmap_bit_position("stable_id")))).alias("d"), F.count(F.lit(1)).alias("c"))
    return per.groupBy("segment_id").agg(F.sum("s").alias("n_selected"), F.sum("d").alias("n_deleted"), F.sum("c").alias("n"))


@query("F216_attributes", "SELECT stable_id, CASE WHEN selected THEN y END AS sparse_value, CASE WHEN selected THEN y ELSE 0 END::DOUBLE AS dense_value FROM points", "points")
def f216(spark, sf):  # noqa: ANN001, ANN201
    p = points(spark, sf)
    values = p.where("selected").select("stable_id", F.col("y").alias("value"))
    sparse = L.attribute(p.select("stable_id"), values, "value", ["stable_id"], dense=False).withColumnRenamed("value", "sparse_value")
    dense = L.attribute(p.select("stable_id"), values, "value", ["stable_id"], dense=True).withColumnRenamed("value", "dense_value")
    return sparse.join(dense, "stable_id")


@query("F217_sequence_fanout", "SELECT 'visible' AS scope, count(*) AS n FROM points WHERE segment_id = 1 AND NOT deleted UNION ALL SELECT 'global', count(*) FROM points WHERE NOT deleted", "points")
def f217(spark, sf):  # noqa: ANN001, ANN201
    live = points(spark, sf).where("not deleted")
    one = live.where("segment_id = 1").agg(F.lit("visible").alias("scope"), F.count(F.lit(1)).alias("n"))
    return one.union(live.agg(F.lit("global"), F.count(F.lit(1))))


@query("F218_edit_log", "SELECT user_id AS stable_id, arg_max(event_type, event_id) AS state, max(event_id) AS op_seq FROM events WHERE event_id <= (SELECT max(event_id) - 64 FROM events) GROUP BY 1")
def f218(spark, sf):  # noqa: ANN001, ANN201
    log = read(spark, sf, "events").select(F.col("user_id").alias("stable_id"), F.col("event_type").alias("state"), F.col("event_id").alias("op_seq"))
    undone = log.join(F.broadcast(log.agg((F.max("op_seq") - 64).alias("upto"))), F.col("op_seq") <= F.col("upto")).drop("upto")
    return L.latest(undone, ["stable_id"]).select("stable_id", "state", "op_seq")


@query("F219_crop_tracks", "SELECT track FROM keys GROUP BY track HAVING bool_and(x <= 45 AND y <= 9)", "keys")
def f219(spark, sf):  # noqa: ANN001, ANN201
    return L.tracks_inside(keys(spark, sf), (F.col("x") <= 45) & (F.col("y") <= 9)).where("all_in").select("track")


@query("F220_mask_to_ids", "SELECT segment_id, stable_id FROM points WHERE selected", "points")
def f220(spark, sf):  # noqa: ANN001, ANN201
    return points(spark, sf).where("selected").select("segment_id", "stable_id")


@query("F221_selection_bounds", "SELECT segment_id, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM points WHERE selected AND NOT deleted GROUP BY 1", "points")
def f221(spark, sf):  # noqa: ANN001, ANN201
    rows = L.selected_ids(points(spark, sf)).where(N.finite(F.col("x")) & N.finite(F.col("z")))
    return rows.groupBy("segment_id").agg(*[r(f(c), f"{n}_{c}") for c in "xz" for n, f in (("min", F.min), ("max", F.max))])
