"""Whole assets: parts of F005 to F029, F302, F428, F429 and F825."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assets as E
from ..operators import boundary as J
from ..operators import sampling as S
from ..operators import selection as L
from ..sinks import report
from ..sinks.ply import compacted, sequence_names
from ..sources.container import catalog_check
from .base import keys, points, query, read, vectors
from .joins import LINES, _lines
from .sampling import OPACITY, r


@query("F005_static_broadcast", "SELECT stable_id, x AS bank_0, y AS bank_1, 'dynamic' AS source_element FROM points WHERE segment_id = 0 UNION ALL SELECT stable_id + 1000000, x, x, 'static' FROM points WHERE segment_id = 1", "points")
def f005(spark, sf):  # noqa: ANN001, ANN201
    p = points(spark, sf)
    dynamic = p.where("segment_id = 0").select("stable_id", F.col("x").alias("bank_0"), F.col("y").alias("bank_1"))
    return E.with_static(dynamic, p.where("segment_id = 1"), {"x": ["bank_0", "bank_1"]}, 1_000_000)


@query("F010_dequantize_planes", "MORE q AS (SELECT track, k, -2.0 + 5.0 * (v16 / 65535.0) AS v FROM keys) SELECT track, k, round(sign(v) * (exp(abs(v)) - 1), 6)::DOUBLE AS value FROM q", "keys")
def f010(spark, sf):  # noqa: ANN001, ANN201
    v = E.dequantize_mean(F.col("v16") % 256, F.floor(F.col("v16") / 256), -2.0, 3.0)
    return keys(spark, sf).select("track", "k", r(v, "value"))


@query("F014_demo_torus", "WITH i AS (SELECT i AS stable_id, (i + 0.5::DOUBLE) * ((sqrt(5.0) - 1) / 2) AS a, (i + 0.5::DOUBLE) * (sqrt(2.0) - 1) AS b FROM (SELECT unnest(range(5000)) AS i)), t AS (SELECT stable_id, (a - floor(a)) * 2 * pi() AS u, (b - floor(b)) * 2 * pi() AS v FROM i) SELECT stable_id, round((2 + 0.6 * cos(v)) * cos(u), 5)::DOUBLE AS x, round(0.6 * sin(v), 5)::DOUBLE AS y, round((2 + 0.6 * cos(v)) * sin(u), 5)::DOUBLE AS z FROM t")
def f014(spark, sf):  # noqa: ANN001, ANN201
    return E.torus(spark, 5000).select("stable_id", *[(F.round(a, 5) + 0.0).alias(a) for a in "xyz"])


@query("F020_compacted", "SELECT segment_id, stable_id, x FROM points WHERE NOT deleted", "points")
def f020(spark, sf):  # noqa: ANN001, ANN201
    p = points(spark, sf)
    return compacted(p.select("segment_id", "stable_id", "x"), p.select("segment_id", "stable_id", "deleted"))


@query("F022_frame_sequence", "MORE f AS (SELECT unnest([5.0::DOUBLE, 15.0::DOUBLE]) AS f) SELECT stable_id, 'frame_' || lpad(CAST(f::INTEGER AS VARCHAR), 6, '0') || '.ply' AS file, round(" + OPACITY.format(f="f") + ", 6) AS alpha FROM points, f WHERE NOT deleted", "points")
def f022(spark, sf):  # noqa: ANN001, ANN201
    rows = S.over_frames(points(spark, sf).where("not deleted"), (5.0, 15.0))
    alpha = S.opacity(F.col("frame"), F.col("opacity"), F.col("mu"), F.col("w"))
    return sequence_names(rows.withColumn("alpha", alpha).withColumn("frame", F.col("frame").cast("int"))).select("stable_id", "file", r(F.col("alpha"), "alpha"))


@query("F026_canonical_rows", "SELECT v AS x, 0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny, 0.0::DOUBLE AS nz, track, k, v FROM keys", "keys")
def f026(spark, sf):  # noqa: ANN001, ANN201
    return E.canonical(keys(spark, sf).select("track", "k", "v"), {"x": "v"})


@query("F028_workspace_edits", "SELECT segment_id, stable_id, deleted, selected FROM points WHERE deleted OR selected", "points")
def f028(spark, sf):  # noqa: ANN001, ANN201
    return points(spark, sf).where("deleted or selected").select("segment_id", "stable_id", "deleted", "selected")


@query("F302_encoder_match", f"WITH {LINES}, p AS (SELECT pk, count(*) AS n FROM l WHERE flag = 'R' GROUP BY 1), c AS (SELECT pk, count(*) AS n FROM l WHERE flag = 'A' GROUP BY 1) SELECT sum(least(p.n, c.n))::BIGINT AS matched, sum(CASE WHEN p.n > 1 THEN least(p.n, c.n) ELSE 0 END)::BIGINT AS duplicates FROM p JOIN c USING (pk)")
def f302(spark, sf):  # noqa: ANN001, ANN201
    m = J.exact_match(_lines(spark, sf, "R", "prev").drop("sk"), _lines(spark, sf, "A", "cur").drop("sk"), ["pk"], weights=[4, 2])
    return m.agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("candidates") > 1).alias("duplicates"))


@query("F428_profile_sweep", "SELECT 'strict' AS profile, count(*) FILTER (abs(x - y) <= 5 AND abs(z) <= 2) AS matched FROM keys UNION ALL SELECT 'safe', count(*) FILTER (abs(x - y) <= 15 AND abs(z) <= 4) FROM keys UNION ALL SELECT 'relaxed', count(*) FILTER (abs(x - y) <= 40 AND abs(z) <= 8) FROM keys", "keys")
def f428(spark, sf):  # noqa: ANN001, ANN201
    rows = keys(spark, sf).select((F.col("x") - F.col("y")).alias("d"), "z")
    return E.sweep(rows, ["d", "z"], {"strict": (5, 2), "safe": (15, 4), "relaxed": (40, 8)})


@query("F429_catalog_check", "SELECT o_orderkey AS id, 'differs: n' AS problem FROM orders WHERE o_orderkey % 10 = 0 AND o_custkey % 2 = 1 UNION ALL SELECT o_orderkey, 'no file' FROM orders WHERE o_orderkey % 10 = 5")
def f429(spark, sf):  # noqa: ANN001, ANN201
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("n"))
    files = o.where("id % 10 != 5").select("id", F.when(F.col("id") % 10 == 0, F.floor(F.col("n") / 2) * 2).otherwise(F.col("n")).alias("n"))
    return catalog_check(o, files, ["n"], "id")


#: Sums of I - d d' and of its product with the ray's point, and Cramer's rule.
CENTRE_SUMS = ", ".join([f"sum({int(i == j)} - d{a} * d{b}) AS m{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz")] + [f"sum(p{a} - d{a} * (dx * px + dy * py + dz * pz)) AS r{i}" for i, a in enumerate("xyz")])


def _cramer(column: int | None) -> str:
    m = [[f"r{i}" if j == column else f"m{i}{j}" for j in range(3)] for i in range(3)]
    return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"


@query("F825_standing_centre", f"MORE y AS (SELECT vec_id % 9 AS pose, e[1] / n AS dx, e[2] / n AS dy, e[3] / n AS dz, e[4] AS px, e[5] AS py, e[6] AS pz FROM (SELECT *, sqrt(e[1]**2 + e[2]**2 + e[3]**2) AS n FROM vectors)), s AS (SELECT pose, count(*) AS n, {CENTRE_SUMS} FROM y GROUP BY 1) SELECT pose, {', '.join(f'round({_cramer(i)} / {_cramer(None)}, 5)::DOUBLE AS {a}' for i, a in enumerate('xyz'))}, n FROM s", "vectors")
def f825(spark, sf):  # noqa: ANN001, ANN201
    e = lambda i: F.get("e", F.lit(i))
    n = F.sqrt(e(0) ** 2 + e(1) ** 2 + e(2) ** 2)
    rays = vectors(spark, sf).select((F.col("vec_id") % 9).alias("pose"), (e(0) / n).alias("dx"), (e(1) / n).alias("dy"), (e(2) / n).alias("dz"), e(3).alias("px"), e(4).alias("py"), e(5).alias("pz"))
    return E.standing_centre(rays, "pose").select("pose", *[(F.round(a, 5) + 0.0).alias(a) for a in "xyz"], "n")


@query("F213_newly_deleted_ids", "SELECT stable_id FROM points WHERE selected AND NOT deleted", "points")
def f213b(spark, sf):  # noqa: ANN001, ANN201
    return L.delete_selected(points(spark, sf)).where("newly").select("stable_id")


REPORT = ["event_type", "count", "mean", "note"]


def _audit(spark, sf):  # noqa: ANN001, ANN202
    rows = read(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("count"), F.format_string("%.2f", F.round(F.avg("value"), 2)).alias("mean"))
    return rows.withColumn("note", F.concat(F.lit('a "'), "event_type", F.lit('", <b>|')))


AUDIT = """WITH a AS (SELECT event_type AS e, count(*) AS n, printf('%.2f', round(avg(value), 2)) AS m FROM events GROUP BY 1) SELECT """


@query("F029_audit_csv", AUDIT + """e || ',' || n || ',' || m || ',"a ""' || e || '"", <b>|"' AS line FROM a""")
def f029_csv(spark, sf):  # noqa: ANN001, ANN201
    return report.lines(_audit(spark, sf), "csv", REPORT)


@query("F029_audit_markdown", AUDIT + """'| ' || e || ' | ' || n || ' | ' || m || ' | a "' || e || '", <b>' || chr(92) || '| |' AS line FROM a""")
def f029_markdown(spark, sf):  # noqa: ANN001, ANN201
    return report.lines(_audit(spark, sf), "markdown", REPORT)


@query("F029_audit_html", AUDIT + """'<tr><td>' || e || '</td><td>' || n || '</td><td>' || m || '</td><td>a "' || e || '", &lt;b&gt;|</td></tr>' AS line FROM a""")
def f029_html(spark, sf):  # noqa: ANN001, ANN201
    return report.lines(_audit(spark, sf), "html", REPORT)
