"""Meshes as vertex and triangle tables: components, normals, volume, borders, holes, smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .graph import components

CORNERS = ("a", "b", "c")


def triangle_edges(triangles: DataFrame) -> DataFrame:
    """``(u, v, t)`` of each triangle's three edges, ends ordered."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return triangles.select("t", F.explode(pairs).alias("e")).select("e.u", "e.v", "t")


def border_edges(triangles: DataFrame) -> DataFrame:
    """Edges of exactly one triangle."""
    return triangle_edges(triangles).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("u", "v")


def large_components(triangles: DataFrame, least: int = 24, share: float = 0.0015) -> DataFrame:
    """Triangles of components with at least max(24, 0.15 % of the largest, rounded down) triangles."""
    e = triangle_edges(triangles)
    roots = components(e.select(F.col("u").alias("a"), F.col("v").alias("b")))
    placed = triangles.join(roots.withColumnRenamed("v", "a"), "a")
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.greatest(F.lit(float(least)), F.floor(F.max("n") * share)).alias("need"))
    good = sizes.crossJoin(F.broadcast(largest)).where("n >= need").select("root", "n")
    return placed.join(good, "root").select("t", "a", "b", "c", "root", "n")


def with_corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with their corners' positions as structs pa, pb, pc."""
    out = triangles
    for c in CORNERS:
        out = out.join(vertices.select(F.col("v").alias(c), F.struct("x", "y", "z").alias(f"p{c}")), c)
    return out


def cross(p: Column, q: Column) -> tuple[Column, Column, Column]:
    return p["y"] * q["z"] - p["z"] * q["y"], p["z"] * q["x"] - p["x"] * q["z"], p["x"] * q["y"] - p["y"] * q["x"]


def _minus(p: Column, q: Column) -> Column:
    return F.struct(*[(p[a] - q[a]).alias(a) for a in "xyz"])


def _length(x: str, y: str, z: str) -> Column:
    return F.sqrt(F.col(x) ** 2 + F.col(y) ** 2 + F.col(z) ** 2)


def vertex_normals(triangles: DataFrame, vertices: DataFrame, weight: str = "area") -> DataFrame:
    """``(v, nx, ny, nz)``: unit normals, each corner's face weighted by ``area`` or by the corner's ``angle``, summed by vertex."""
    flat = with_corners(triangles, vertices).withColumns({"_e": _minus(F.col("pb"), F.col("pa")), "_f": _minus(F.col("pc"), F.col("pa"))})
    flat = flat.withColumns(dict(zip(("_nx", "_ny", "_nz"), cross(F.col("_e"), F.col("_f")), strict=True)))
    if weight == "angle":
        norm = lambda p: F.sqrt(p["x"] ** 2 + p["y"] ** 2 + p["z"] ** 2)

        def angle(at: str, left: str, right: str) -> Column:
            p, q = _minus(F.col(left), F.col(at)), _minus(F.col(right), F.col(at))
            cosine = (p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]) / F.greatest(norm(p) * norm(q), F.lit(1e-20))
            return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))

        size = _length("_nx", "_ny", "_nz")
        weights = [angle("pa", "pb", "pc"), angle("pb", "pc", "pa"), angle("pc", "pa", "pb")]
        weights = [F.when(size > 1e-12, w / F.when(size > 1e-12, size)).otherwise(0.0) for w in weights]
    else:
        weights = [F.lit(1.0)] * 3
    corners = F.explode(F.array(*[F.struct(F.col(c).alias("v"), w.alias("w")) for c, w in zip(CORNERS, weights, strict=True)])).alias("_c")
    rows = flat.select(corners, "_nx", "_ny", "_nz").select("_c.v", *[(F.col(f"_n{k}") * F.col("_c.w")).alias(k) for k in "xyz"])
    sums = rows.groupBy("v").agg(*[F.sum(k).alias(k) for k in "xyz"])
    size = _length("x", "y", "z")
    return sums.select("v", *[F.when(size > 1e-12, F.col(k) / F.when(size > 1e-12, size)).otherwise(0.0).alias(f"n{k}") for k in "xyz"])


def signed_volume(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: a sixth of the sum of corner determinants; positive for outward faces."""
    n = cross(F.col("pb"), F.col("pc"))
    det = F.col("pa.x") * n[0] + F.col("pa.y") * n[1] + F.col("pa.z") * n[2]
    return with_corners(triangles, vertices).agg((F.sum(det) / 6).alias("volume"), F.count(F.lit(1)).alias("triangles"))


#: Fixed values of the smoothing: widths and limits, in spacings where lengths.
CREASE_DEGREES, NORMAL_SIGMA, SPATIAL_SIGMA, REACH, STEP, DRIFT, SHARE, MOST_ROUNDS = 35.0, 0.18, 2.5, 4.5, 0.25, 0.5, 0.45, 5


def smooth(vertices: DataFrame, triangles: DataFrame, spacing: float, rounds: int = 1) -> DataFrame:
    """``(v, x, y, z)``: vertices moved along their normals towards their neighbours' surface.

    Neighbours count by nearness and by how alike their normals are, not at all
    beyond a crease of 35 degrees or 4.5 spacings; one shared by two triangles
    counts twice. A round moves a vertex by a quarter of a spacing at most, all
    rounds together by half; there are five at most. Each round is written, as the
    next one reads it several times.
    """
    e = triangle_edges(triangles).select("u", "v")
    both = stage(e.union(e.select("v", "u")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("m")), "neighbours")
    now = stage(vertices.select("v", *[F.col(a).cast("double").alias(a) for a in "xyz"], *[F.col(a).cast("double").alias(f"{a}0") for a in "xyz"]), "smooth")
    wide = max(1e-8, spacing * SPATIAL_SIGMA)
    for _ in range(max(0, min(MOST_ROUNDS, rounds))):
        state = now.join(vertex_normals(triangles, now), "v", "left").fillna(0.0, ["nx", "ny", "nz"])
        state = stage(state, "normals")
        there = state.select(F.col("v"), *[F.col(c).alias(f"o{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
        here = state.select(F.col("v").alias("u"), "x", "y", "z", "nx", "ny", "nz")
        d = {a: F.col(f"o{a}") - F.col(a) for a in "xyz"}
        dot = sum((F.col(f"n{a}") * F.col(f"on{a}") for a in "yz"), F.col("nx") * F.col("onx"))
        far = d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2
        pairs = both.join(there, "v").join(here, "u").withColumns({"dot": dot, "far": far, "height": d["x"] * F.col("nx") + d["y"] * F.col("ny") + d["z"] * F.col("nz")})
        pairs = pairs.where((F.col("dot") >= math.cos(math.radians(CREASE_DEGREES))) & (F.col("far") <= (spacing * REACH) ** 2))
        apart = 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dot")))
        weight = F.col("m") * F.exp(-F.col("far") / (2 * wide * wide)) * F.exp(-apart * apart / (2 * NORMAL_SIGMA**2))
        sums = pairs.groupBy(F.col("u").alias("v")).agg(F.sum(F.col("height") * weight).alias("h"), F.sum(weight).alias("w"))
        step = F.greatest(F.lit(-spacing * STEP), F.least(F.lit(spacing * STEP), F.col("h") / F.col("w") * SHARE))
        moved = state.join(sums, "v", "left").withColumn("step", F.when(F.col("w") > 1e-8, step).otherwise(0.0))
        off = moved.withColumns({f"d{a}": F.col(a) + F.col(f"n{a}") * F.col("step") - F.col(f"{a}0") for a in "xyz"})
        drift = _length("dx", "dy", "dz")
        back = F.when(drift > spacing * DRIFT, spacing * DRIFT / drift).otherwise(1.0)
        now = stage(off.select("v", *[(F.col(f"{a}0") + F.col(f"d{a}") * back).alias(a) for a in "xyz"], *[f"{a}0" for a in "xyz"]), "smooth")
    return now.select("v", "x", "y", "z")


def fill_holes(triangles: DataFrame, vertices: DataFrame, diameter: float, least: int = 4, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """New ``triangles(a, b, c)`` and ``vertices(v, x, y, z)`` that close small holes of a mesh.

    A hole is a closed loop of ``least`` to ``most`` border edges on which every
    vertex has two of them, with a bounding box of ``diameter`` across at most. Its
    new vertex is the mean of the loop's; numbers are -1 - (the loop's smallest
    vertex). Each border edge gives a triangle that runs against its neighbour's.
    """
    pairs = F.array(*[F.struct(F.col(p).alias("from"), F.col(q).alias("to")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    edges = triangles.select(F.explode(pairs).alias("e")).select(F.least("e.from", "e.to").alias("u"), F.greatest("e.from", "e.to").alias("v"), "e.from", "e.to")
    border = edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.first("from").alias("from"), F.first("to").alias("to")).where("n = 1 and u <> v")
    border = stage(border.select("u", "v", "from", "to"), "border")
    degree = border.select(F.explode(F.array("u", "v")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    roots = components(border.select(F.col("u").alias("a"), F.col("v").alias("b")))
    placed = degree.join(roots, "v").join(vertices.select("v", "x", "y", "z"), "v", "left")
    across = lambda a: (F.max(a) - F.min(a)) ** 2
    loops = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("degree").alias("high"), F.min("degree").alias("low"), F.sqrt(across("x") + across("y") + across("z")).alias("size"), *[F.avg(a).alias(a) for a in "xyz"])
    holes = stage(loops.where(F.col("n").between(least, most) & (F.col("high") == 2) & (F.col("low") == 2) & (F.col("size") <= diameter)), "holes")
    centre = (-1 - F.col("root")).alias("c")
    rim = border.join(roots.withColumnRenamed("v", "u"), "u").join(holes.select("root"), "root")
    return rim.select(F.col("to").alias("a"), F.col("from").alias("b"), centre), holes.select((-1 - F.col("root")).alias("v"), "x", "y", "z")
