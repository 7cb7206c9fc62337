"""Scalar functions (F701 to F721) and format scalars (F007, F017)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import numeric as N
from ..functions import quaternion as Q
from ..operators import images
from ..sources import container
from ..sources.ply import BANK
from .base import keys, points, query, read, vectors
from .sampling import LOGIT, r


@query("F007_half_decode", """MORE b AS (SELECT DISTINCT v16 AS bits FROM keys), p AS (SELECT bits, CASE WHEN bits >= 32768 THEN -1.0 ELSE 1.0 END AS s, (bits >> 10) & 31 AS e, (bits & 1023)::DOUBLE AS m FROM b)
SELECT bits, e = 31 AS special, CASE WHEN e = 31 THEN 0.0 WHEN e = 0 THEN s * m * pow(2.0, -24) ELSE s * (1024 + m) * pow(2.0, e - 25) END::DOUBLE + 0.0 AS value FROM p""", "keys")
def f007(spark, sf):  # noqa: ANN001, ANN201
    rows = keys(spark, sf).select(F.col("v16").alias("bits")).distinct()
    value = B.half_to_double(F.col("bits"))
    return rows.select("bits", (~N.finite(value)).alias("special"), (F.when(N.finite(value), value).otherwise(0.0) + 0.0).alias("value"))


@query("F007_half_encode", "MORE b AS (SELECT DISTINCT v16 AS bits FROM keys) SELECT bits, CASE WHEN (bits >> 10) & 31 = 31 AND bits & 1023 != 0 THEN 31744 ELSE bits END::INTEGER AS again FROM b", "keys")
def f007b(spark, sf):  # noqa: ANN001, ANN201
    """Every pattern comes back, infinities too; what is not a number becomes infinity, as overflow does."""
    rows = keys(spark, sf).select(F.col("v16").alias("bits")).distinct()
    return rows.select("bits", B.double_to_half(B.half_to_double(F.col("bits"))).cast("int").alias("again"))


@query("F017_frame_range", r"SELECT page_id, coalesce(nullif(regexp_extract(url, '(\d+)[_-](\d+)', 1), ''), '-') AS first, regexp_extract(url, '/([a-z]{2})/', 1) AS lang FROM pages")
def f017(spark, sf):  # noqa: ANN001, ANN201
    first = F.nullif(F.regexp_extract("url", r"(\d+)[_-](\d+)", 1), F.lit(""))
    return read(spark, sf, "pages").select("page_id", F.coalesce(first, F.lit("-")).alias("first"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"))


@query("F701_sigmoid_logit", f"SELECT stable_id, round(1 / (1 + exp(-opacity)), 9) AS alpha, round({LOGIT.format(a='(1 / (1 + exp(-opacity)))')}, 6) AS back, round(least(opacity, 0) - ln(1 + exp(-abs(opacity))), 9) AS log_alpha FROM points", "points")
def f701(spark, sf):  # noqa: ANN001, ANN201
    o = F.col("opacity")
    return points(spark, sf).select("stable_id", (F.round(N.sigmoid(o), 9) + 0.0).alias("alpha"), r(N.logit(N.sigmoid(o)), "back"), (F.round(N.log_sigmoid(o), 9) + 0.0).alias("log_alpha"))


MUL = "e[1]*e[5]-e[2]*e[6]-e[3]*e[7]-e[4]*e[8]", "e[1]*e[6]+e[2]*e[5]+e[3]*e[8]-e[4]*e[7]", "e[1]*e[7]-e[2]*e[8]+e[3]*e[5]+e[4]*e[6]", "e[1]*e[8]+e[2]*e[7]-e[3]*e[6]+e[4]*e[5]"


def _e(i: int):  # noqa: ANN202
    return F.get("e", F.lit(i - 1))


@query("F702_quaternion_algebra", f"MORE m AS (SELECT vec_id, {MUL[0]} AS w, {MUL[1]} AS x, {MUL[2]} AS y, {MUL[3]} AS z FROM vectors) SELECT vec_id, round(w, 6) AS qw, round(x, 6) AS qx, round(y, 6) AS qy, round(z, 6) AS qz, round(sqrt(w*w+x*x+y*y+z*z), 6) AS size FROM m", "vectors")
def f702(spark, sf):  # noqa: ANN001, ANN201
    q = Q.multiply(Q.quat(*[_e(i) for i in (1, 2, 3, 4)]), Q.quat(*[_e(i) for i in (5, 6, 7, 8)]))
    return vectors(spark, sf).withColumn("q", q).select("vec_id", *[r(F.col(f"q.{n}"), f"q{n}") for n in Q.AXES], r(F.sqrt(Q.dot(F.col("q"), F.col("q"))), "size"))


@query("F703_quaternion_log_exp", "MORE n AS (SELECT vec_id, e, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4]) AS n, CASE WHEN e[1] < 0 THEN -1 ELSE 1 END AS s FROM vectors) SELECT vec_id, round(s * e[1] / n, 6) AS qw, round(s * e[2] / n, 6) AS qx, round(2 * acos(least(1.0, abs(e[1] / n))), 5) AS angle FROM n", "vectors")
def f703(spark, sf):  # noqa: ANN001, ANN201
    rows = vectors(spark, sf).withColumn("q", Q.normalize(Q.quat(*[_e(i) for i in (1, 2, 3, 4)]))).withColumn("v", Q.log(F.col("q"))).withColumn("b", Q.exp(F.col("v")))
    angle = F.sqrt(F.col("v.x") ** 2 + F.col("v.y") ** 2 + F.col("v.z") ** 2)
    return rows.select("vec_id", r(F.col("b.w"), "qw"), r(F.col("b.x"), "qx"), (F.round(angle, 5) + 0.0).alias("angle"))


@query("F704_smallest_three", "SELECT vec_id, list_position(list_transform(e[1:4], lambda v: abs(v)), list_max(list_transform(e[1:4], lambda v: abs(v)))) - 1 AS largest, true AS close FROM vectors", "vectors")
def f704(spark, sf):  # noqa: ANN001, ANN201
    rows = vectors(spark, sf).withColumn("q", Q.normalize(Q.quat(*[_e(i) for i in (1, 2, 3, 4)]))).withColumn("c", Q.smallest_three(F.col("q"))).withColumn("b", Q.from_smallest_three(F.col("c")))
    return rows.select("vec_id", F.col("c.largest").alias("largest"), (Q.angle_degrees(F.col("q"), Q.normalize(F.col("b"))) < 0.1).alias("close"))


@query("F705_quaternion_angle", "MORE n AS (SELECT vec_id, e, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4]) AS a, sqrt(e[5]*e[5]+e[6]*e[6]+e[7]*e[7]+e[8]*e[8]) AS b FROM vectors) SELECT vec_id, round(2 * acos(least(1.0, abs((e[1]*e[5]+e[2]*e[6]+e[3]*e[7]+e[4]*e[8]) / (a * b)))) * 180 / pi(), 5) AS degrees FROM n", "vectors")
def f705(spark, sf):  # noqa: ANN001, ANN201
    rows = vectors(spark, sf).select("vec_id", Q.normalize(Q.quat(*[_e(i) for i in (1, 2, 3, 4)])).alias("a"), Q.normalize(Q.quat(*[_e(i) for i in (5, 6, 7, 8)])).alias("b"))
    return rows.select("vec_id", (F.round(Q.angle_degrees(F.col("a"), F.col("b")), 5) + 0.0).alias("degrees"))


@query("F706_ordered_half", "SELECT track, k, CASE WHEN v16 >= 32768 THEN 65535 - v16 ELSE v16 + 32768 END::INTEGER AS code, v16 AS again FROM keys", "keys")
def f706(spark, sf):  # noqa: ANN001, ANN201
    code = B.ordered_half(F.col("v16"))
    return keys(spark, sf).select("track", "k", code.alias("code"), B.half_from_ordered(code).alias("again"))


@query("F707_zigzag_varint", "MORE d AS (SELECT track, k, v - 50000 AS d FROM keys), z AS (SELECT *, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS u FROM d) SELECT track, k, u AS zigzag, d AS again, (1 + (u >= 128)::INTEGER + (u >= 16384)::INTEGER + (u >= 2097152)::INTEGER)::INTEGER AS bytes FROM z", "keys")
def f707(spark, sf):  # noqa: ANN001, ANN201
    u = B.zigzag(F.col("v") - 50000)
    return keys(spark, sf).select("track", "k", u.alias("zigzag"), B.unzigzag(u).alias("again"), B.varint_size(u).alias("bytes"))


@query("F708_ycocg", "MORE c AS (SELECT track, k, (v16 % 256)::INTEGER AS r, (v16 // 256)::INTEGER AS g, (v % 251)::INTEGER AS b FROM keys), t AS (SELECT *, r - b AS co, b + ((r - b) >> 1) AS t FROM c) SELECT track, k, (t + ((g - t) >> 1))::INTEGER AS y, co::INTEGER AS co, (g - t)::INTEGER AS cg, true AS lossless FROM t", "keys")
def f708(spark, sf):  # noqa: ANN001, ANN201
    c = keys(spark, sf).select("track", "k", (F.col("v16") % 256).cast("int").alias("r"), F.floor(F.col("v16") / 256).cast("int").alias("g"), (F.col("v") % 251).cast("int").alias("b"))
    y, co, cg = N.ycocg_forward(F.col("r"), F.col("g"), F.col("b"))
    rows = c.withColumns({"y": y, "co": co, "cg": cg})
    back = N.ycocg_inverse(F.col("y"), F.col("co"), F.col("cg"))
    same = (back[0] == F.col("r")) & (back[1] == F.col("g")) & (back[2] == F.col("b"))
    return rows.select("track", "k", "y", "co", "cg", same.alias("lossless"))


@query("F709_signed_log", "SELECT vec_id, round(sign(e[1]) * (exp(abs(e[1])) - 1), 9) AS value FROM vectors", "vectors")
def f709(spark, sf):  # noqa: ANN001, ANN201
    return vectors(spark, sf).select("vec_id", (F.round(N.signed_expm1(_e(1)), 9) + 0.0).alias("value"))


@query("F710_quantize_pack", "MORE q AS (SELECT stable_id, greatest(0, least(2047, round_even(x / 600.0 * 2047, 0)))::BIGINT AS a, greatest(0, least(1023, round_even(y / 20000.0 * 1023, 0)))::BIGINT AS b, greatest(0, least(2047, round_even(z / 4000.0 * 2047, 0)))::BIGINT AS c FROM points) SELECT stable_id, a | (b << 11) | (c << 21) AS packed, a, b, c FROM q", "points")
def f710(spark, sf):  # noqa: ANN001, ANN201
    q = points(spark, sf).select("stable_id", N.quantize(F.col("x"), 0.0, 600.0, 11).alias("qa"), N.quantize(F.col("y"), 0.0, 20000.0, 10).alias("qb"), N.quantize(F.col("z"), 0.0, 4000.0, 11).alias("qc"))
    packed = q.select("stable_id", B.pack_xyz(F.col("qa"), F.col("qb"), F.col("qc")).alias("packed"))
    a, b, c = B.unpack_xyz(F.col("packed"))
    return packed.select("stable_id", "packed", a.alias("a"), b.alias("b"), c.alias("c"))


@query("F711_opacity_quantize", "SELECT stable_id, CASE WHEN deleted THEN 0 ELSE 1 + greatest(0, least(65534, round_even((opacity + 10) / 20.0 * 65534, 0))) END::BIGINT AS code FROM points", "points")
def f711(spark, sf):  # noqa: ANN001, ANN201
    o = F.when(F.col("deleted"), N.NEG_INF).otherwise(F.col("opacity"))
    return points(spark, sf).select("stable_id", N.quantize_opacity(o, -10.0, 10.0).alias("code"))


@query("F712_transform_bake", "SELECT stable_id, round(10 + 2 * -y, 5) AS bx, round(20 + 2 * x, 5) AS by_, round(-5 + 2 * z, 5) AS bz, round(w + ln(2.0), 6) AS log_scale FROM points", "points")
def f712(spark, sf):  # noqa: ANN001, ANN201
    import math

    q = Q.from_euler(F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2))
    x, y, z = Q.rotate(F.col("q"), F.col("x") * 2, F.col("y") * 2, F.col("z") * 2)
    rows = points(spark, sf).withColumn("q", q)
    out = lambda c, n: (F.round(c, 5) + 0.0).alias(n)
    return rows.select("stable_id", out(x + 10, "bx"), out(y + 20, "by_"), out(z - 5, "bz"), r(F.col("w") + math.log(2.0), "log_scale"))


#: A turn of 60 degrees about z, and what it does to a harmonic of order m: it mixes with the one of order -m.
TURN = math.pi / 3


def _turned_z() -> str:
    out = []
    for channel in range(3):
        for band in (1, 2, 3):
            for m in range(-band, band + 1):
                at = lambda k: f"e[{15 * channel + band * band - 1 + band + k + 1}]"  # noqa: B023, E731
                mix = f"{math.cos(abs(m) * TURN)!r} * {at(m)}" + (f" + {math.copysign(math.sin(abs(m) * TURN), -m)!r} * {at(-m)}" if m else "")
                out.append(f"round({mix}, 5) AS c{channel}_{band}_{m + band}")
    return ", ".join(out)


@query("F713_sh_rotation", f"SELECT vec_id, {_turned_z()} FROM vectors", "vectors")
def f713(spark, sf):  # noqa: ANN001, ANN201
    """Three channels of 15 coefficients, bands 1 to 3, turned about z."""
    from ..operators.fits import sh_rotation

    q = (math.cos(TURN / 2), 0.0, 0.0, math.sin(TURN / 2))
    out = []
    for band in (1, 2, 3):
        m = sh_rotation(q, band)
        for channel in range(3):
            own = [_e(15 * channel + band * band + j) for j in range(2 * band + 1)]
            for i in range(2 * band + 1):
                out.append((F.round(sum((own[j] * float(m[i, j]) for j in range(1, len(own))), own[0] * float(m[i, 0])), 5) + 0.0).alias(f"c{channel}_{band}_{i}"))
    return vectors(spark, sf).select("vec_id", *out)


@query("F714_shuffle16", "SELECT page_id, octet_length(encode(html))::BIGINT AS n, (octet_length(encode(html)) + octet_length(encode(html)) % 2)::BIGINT AS padded FROM pages")
def f714(spark, sf):  # noqa: ANN001, ANN201
    from ..operators.streams import shuffle16, unshuffle16

    rows = read(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("raw"))
    rows = rows.select("page_id", F.octet_length("raw").cast("long").alias("n"), "raw", shuffle16("raw").alias("s"))
    same = F.when(unshuffle16("s", "n") == F.col("raw"), F.octet_length("s").cast("long"))
    return rows.select("page_id", "n", same.alias("padded"))


@query("F715_digests", "SELECT doc_id, sha256(text) AS sha FROM documents")
def f715(spark, sf):  # noqa: ANN001, ANN201
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


CRC_STEP = "CASE WHEN {c} % 2 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
CRC_TABLE = f"WITH RECURSIVE b AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS n FROM range(256) t(i) UNION ALL SELECT i, {CRC_STEP.format(c='c')}, n + 1 FROM b WHERE n < 8), t AS (SELECT list(c ORDER BY i) AS t FROM b WHERE n = 8)"


@query("F715_crc32", CRC_TABLE + " SELECT c_custkey, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c_name, ''), lambda x: ord(x)::BIGINT)), lambda a, x: xor(t.t[xor(a, x) % 256 + 1], a >> 8)), 4294967295) AS crc FROM customer, t")
def f715_crc(spark, sf):  # noqa: ANN001, ANN201
    return read(spark, sf, "customer").select("c_custkey", F.crc32(F.encode("c_name", "UTF-8")).alias("crc"))


@query("F716_gray", "SELECT track, k, ((77 * (v16 % 256) + 150 * (v16 // 256) + 29 * (v % 251)) >> 8)::BIGINT AS gray FROM keys", "keys")
def f716(spark, sf):  # noqa: ANN001, ANN201
    return keys(spark, sf).select("track", "k", N.gray(F.col("v16") % 256, F.floor(F.col("v16") / 256), F.col("v") % 251).cast("long").alias("gray"))


#: Images of 8 by 8 pixels, one a vector; the outer ones are even but for one in nine.
PIXELS = """px AS (SELECT vec_id AS image, i % 8 AS x, i // 8 AS y, CASE WHEN (i % 8 IN (0, 7) OR i // 8 IN (0, 7)) AND i % 9 != 4 THEN 90 ELSE floor(128 + 400 * e[i + 1])::BIGINT % 256 END AS r, (i * 3) % 7 AS g, 20 AS b, CASE WHEN e[i + 1] < -0.2 THEN 10 ELSE 255 END AS a FROM vectors, range(64) t(i))"""


def _pixels(spark, sf):  # noqa: ANN001, ANN202
    i = F.col("i")
    rim = (i % 8).isin(0, 7) | F.floor(i / 8).isin(0, 7)
    rows = vectors(spark, sf).select(F.col("vec_id").alias("image"), F.posexplode("e").alias("i", "v"))
    red = F.when(rim & (i % 9 != 4), F.lit(90)).otherwise(F.floor(128 + 400 * F.col("v")) % 256).cast("long")
    return rows.select("image", (i % 8).cast("long").alias("x"), F.floor(i / 8).alias("y"), red.alias("r"), ((i * 3) % 7).cast("long").alias("g"), F.lit(20).alias("b"), F.when(F.col("v") < -0.2, 10).otherwise(255).alias("a"))


@query("F716_foreground", f"""MORE {PIXELS}, bp AS (SELECT image, r, g, b FROM px WHERE y IN (0, 7) UNION ALL SELECT image, r, g, b FROM px WHERE x IN (0, 7) AND y BETWEEN 1 AND 6),
bg AS (SELECT image, list_sort(list(r))[count(*) // 2 + 1] AS r, list_sort(list(g))[count(*) // 2 + 1] AS g, list_sort(list(b))[count(*) // 2 + 1] AS b FROM bp GROUP BY 1),
m AS (SELECT p.image, x, y, greatest(abs(p.r - bg.r), abs(p.g - bg.g), abs(p.b - bg.b)) >= 18 AND a >= 32 AS mask FROM px p JOIN bg USING (image))
SELECT m.image, m.x, m.y, bool_or(m.mask OR coalesce(n.mask, false)) AS mask FROM m LEFT JOIN m n ON n.image = m.image AND abs(n.x - m.x) + abs(n.y - m.y) = 1 AND n.x BETWEEN 1 AND 6 AND n.y BETWEEN 1 AND 6 GROUP BY 1, 2, 3""", "vectors")
def f716_mask(spark, sf):  # noqa: ANN001, ANN201
    return images.foreground(_pixels(spark, sf))


@query("F717_refined_disparities")
def f717(spark, sf):  # noqa: ANN001, ANN201
    """Disparities of 8 by 8 pixels from each vector; tests compare with the method pixel by pixel."""
    value = lambda v: F.when(v < -0.12, 0).otherwise(F.floor(100 + 60 * v)).cast("int")
    rows = vectors(spark, sf).select(F.col("vec_id").alias("image"), F.lit(8).alias("columns"), F.transform("e", value).alias("disparity"), F.transform("e", lambda v: (v < 0.2).cast("int")).alias("foreground"))
    return images.refine_disparities(rows)


@query("F426_render_error", """MORE p AS (SELECT vec_id AS image, i % 8 AS x, i // 8 AS y, greatest(0, least(255, floor(128 + 400 * e[i + 1]))) AS a FROM vectors, range(64) t(i)), q AS (SELECT *, a - a % 8 AS b FROM p), c AS (SELECT * FROM (VALUES (3, 3), (4, 3), (3, 4), (4, 4)) t(cx, cy)),
w AS (SELECT image, cx, cy, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS ab FROM q, c WHERE abs(x - cx) <= 3 AND abs(y - cy) <= 3 GROUP BY ALL),
s AS (SELECT image, avg((2 * ma * mb + 6.5025) * (2 * ab + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))) AS ssim FROM w GROUP BY 1),
g AS (SELECT image, avg((a - b) ** 2) AS mse, avg((a - b) ** 2) FILTER (greatest(a, b) > 25) AS front, avg(abs(a - b)) AS mae, max(abs(a - b)) AS worst, count(*) FILTER (greatest(a, b) > 25) AS n FROM q GROUP BY 1)
SELECT image, round(10 * log10(65025 / nullif(mse, 0)), 5) AS psnr, round(10 * log10(65025 / nullif(front, 0)), 5) AS foreground_psnr, round(ssim, 5) AS ssim, round(mae, 6) AS mae, worst::BIGINT AS max_error, n AS foreground_pixels FROM g JOIN s USING (image)""", "vectors")
def f426(spark, sf):  # noqa: ANN001, ANN201
    """Eight grey levels a step against the whole range, one channel."""
    rows = vectors(spark, sf).select(F.col("vec_id").alias("image"), F.posexplode("e").alias("i", "v"))
    a = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * F.col("v"))))
    rows = rows.select("image", F.lit(0).alias("channel"), (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), a.alias("a"), (a - a % 8).alias("b"))
    out = images.render_error(rows)
    near = lambda c, d=5: (F.round(c, d) + 0.0).alias(c)
    return out.select("image", near("psnr"), near("foreground_psnr"), near("ssim"), near("mae", 6), "max_error", "foreground_pixels")


@query("F718_sanitize", "SELECT stable_id, greatest(0.0, least(100.0, x)) AS clamped FROM points", "points")
def f718(spark, sf):  # noqa: ANN001, ANN201
    return points(spark, sf).select("stable_id", N.clamp(F.col("x"), 0.0, 100.0).alias("clamped"))


BANKS = r"^(xyz|rot|f_dc|scale|opacity)_bank_?(\d+)(?:_(\d+))?$"


@query("F719_names", rf"WITH n AS (SELECT page_id, url, ['xyz_bank_', 'rot_bank', 'f_dc_bank_', 'opacity_bank_', 'normal_bank_', 'scale_'][page_id % 6 + 1] || page_id % 13 || CASE WHEN page_id % 4 = 0 THEN '' ELSE '_' || page_id % 3 END AS bank FROM pages) SELECT page_id, regexp_replace(url, '\.[A-Za-z0-9]+$', '') AS stem, 'frame_' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '.ply' AS file, regexp_extract(bank, '{BANKS}', 1) AS track, try_cast(regexp_extract(bank, '{BANKS}', 2) AS INTEGER) AS key, try_cast(regexp_extract(bank, '{BANKS}', 3) AS INTEGER) AS component FROM n")
def f719(spark, sf):  # noqa: ANN001, ANN201
    file = F.concat(F.lit("frame_"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".ply"))
    start = F.get(F.array(*[F.lit(n) for n in ("xyz_bank_", "rot_bank", "f_dc_bank_", "opacity_bank_", "normal_bank_", "scale_")]), F.col("page_id") % 6)
    bank = F.concat(start, (F.col("page_id") % 13).cast("string"), F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("_"), (F.col("page_id") % 3).cast("string"))))
    part = lambda i: F.regexp_extract(bank, BANK.pattern, i)
    number = lambda i: F.nullif(part(i), F.lit("")).cast("int")
    return read(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"\.[A-Za-z0-9]+$", "").alias("stem"), file.alias("file"), part(1).alias("track"), number(2).alias("key"), number(3).alias("component"))


@query("F720_json_manifest", """WITH c AS (SELECT c_custkey AS id, c_custkey % 16 AS fault FROM customer), p AS (SELECT id, list_filter([
CASE WHEN fault = 1 THEN 'version' END, CASE WHEN fault = 2 THEN 'slotCount' END, CASE WHEN fault = 3 THEN 'segment counts' END, CASE WHEN fault = 4 THEN 'segment frames' END, CASE WHEN fault = 5 THEN 'stream codec' END,
CASE WHEN fault = 6 THEN 'stream digests' END, CASE WHEN fault IN (7, 8) THEN 'no scale' END, CASE WHEN fault = 9 THEN 'stream named twice' END, CASE WHEN fault = 10 THEN 'no prs_position' END, CASE WHEN fault = 12 THEN 'segment timing' END,
CASE WHEN fault = 13 THEN 'format' END, CASE WHEN fault = 13 THEN 'stream sizes' END], lambda x: x IS NOT NULL) AS p FROM c) SELECT id, array_to_string(list_sort(p), ',') AS problems FROM p""")
def f720(spark, sf):  # noqa: ANN001, ANN201
    """A manifest for each customer, most with a planted fault; 8: only two of three scale axes, 11: all three, 14: a bundle without the usual streams."""
    fault = F.col("c_custkey") % 16
    if_ = lambda n, bad, good: F.when(fault == n, F.lit(bad)).otherwise(F.lit(good))
    banks = F.struct(*[(if_(3, 0, 2) if t == "scale" else F.lit(2)).alias(t) for t in container.TRACKS])
    segment = F.struct(F.lit("segment_0_30").alias("name"), F.lit(100).alias("gaussianCount"), F.lit(31).alias("totalFrames"), F.lit(10).alias("firstFrame"), if_(4, 9, 40).alias("lastFrame"), if_(12, "never", "shared-keyframes").alias("positionTiming"), banks.alias("bankCounts"))
    digest = F.col("digest")

    def stream(name):  # noqa: ANN001, ANN202
        return F.struct(name.alias("name"), if_(5, "zip", "deflate").alias("compression"), F.lit(10).alias("rawBytes"), if_(13, 0, 7).alias("storedBytes"), digest.alias("rawSha256"), F.when(fault == 6, F.lit("xyz")).otherwise(digest).alias("storedSha256"))

    need = F.array(*[F.lit(n) for n in container.REQUIRED_STREAMS])
    need = F.when(fault == 10, F.array_remove(need, "prs_position")).when(fault == 9, F.concat(need, F.array(F.lit("tattr_dc")))).otherwise(need)
    axes = [F.lit(a) for a in container.SCALE_AXES]
    scale = F.when(fault == 7, F.array().cast("array<string>")).when(fault == 8, F.array(*axes[:2])).when(fault == 11, F.array(*axes)).otherwise(F.array(F.lit(container.SCALE)))
    names = F.when(fault == 14, F.array(F.lit("chunk_0"))).otherwise(F.concat(need, scale))
    whole = F.to_json(F.struct(
        if_(13, "5CGS", "4CGS").alias("format"), if_(1, 3, 2).alias("version"), if_(14, container.BUNDLE, "any").alias("codecName"), if_(2, 0, 100).alias("slotCount"), F.lit(31).alias("uniqueFrameCount"),
        F.array(segment).alias("segments"), F.transform(names, stream).alias("streams"),
    ))
    rows = read(spark, sf, "customer").select("c_custkey", "c_name").repartition("c_custkey")  # a file may be one task, a manifest costs far more than its row
    rows = rows.withColumn("digest", F.sha2(F.col("c_name"), 256))
    return rows.select(F.col("c_custkey").alias("id"), F.array_join(container.manifest_problems(whole), ",").alias("problems"))


SIZES = " ".join(f"WHEN n_chars >= {size} THEN ((20 * n_chars + {size}) // {2 * size}) // 10 || '.' || ((20 * n_chars + {size}) // {2 * size}) % 10 || ' {unit}'" for size, unit in ((10**9, "GB"), (10**6, "MB"), (10**3, "kB")))


@query("F721_format_bytes", f"SELECT doc_id, CASE {SIZES} ELSE n_chars || ' B' END AS size FROM documents")
def f721(spark, sf):  # noqa: ANN001, ANN201
    return read(spark, sf, "documents").select("doc_id", N.format_bytes(F.col("n_chars")).alias("size"))
