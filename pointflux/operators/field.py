"""Opacity fields: ellipsoids splatted onto a grid of voxels, and the surface of a level as a mesh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boundary import ellipsoids

#: Edges of a cell between its corners; corner k lies at (k & 1, k >> 1 & 1, k >> 2).
EDGES = [(k, k | 1 << a) for a in range(3) for k in range(8) if not k >> a & 1]
#: Cells are numbered within +-2**20 on each axis.
SHIFT = 1 << 20


def splat(points: DataFrame, spacing: float, sigmas: float = 3.0) -> DataFrame:
    """``(ix, iy, iz, density, winner)`` of the voxels that points reach.

    ``points(stable_id, x, y, z, s0, s1, s2, qw, qx, qy, qz, alpha)``. A voxel's centre
    gets alpha times exp(-d**2 / 2) of each ellipsoid within ``sigmas`` of it; the
    winner gives most, the smaller id of equals. Densities are combined before
    the shuffle.
    """
    rows = ellipsoids(points, sigmas, "alpha")
    place = lambda a, sign: F.floor((F.col(a) + sign * F.col(f"h{a}")) / spacing)
    for a in "xyz":
        rows = rows.withColumn(f"i{a}", F.explode(F.sequence(place(a, -1), place(a, 1))))
    d = [(F.col(f"i{a}") + 0.5) * spacing - F.col(a) for a in "xyz"]
    local = [sum((d[i] * F.col(f"r{i}{j}") for i in (1, 2)), d[0] * F.col(f"r0{j}")) / F.col(f"s{j}") for j in range(3)]
    far = local[0] ** 2 + local[1] ** 2 + local[2] ** 2
    rows = rows.withColumn("far", far).where(F.col("far") <= sigmas * sigmas)
    rows = rows.select("ix", "iy", "iz", "stable_id", (F.col("alpha") * F.exp(-F.col("far") / 2)).alias("w"))
    best = F.max(F.struct("w", (-F.col("stable_id")).alias("n")))
    return rows.groupBy("ix", "iy", "iz").agg(F.sum("w").alias("density"), (-best["n"]).alias("winner"))


def _number(x: Column, y: Column, z: Column) -> Column:
    return ((x + SHIFT) * (1 << 42) + (y + SHIFT) * (1 << 21) + (z + SHIFT)).cast("long")


def surface(field: DataFrame, spacing: float, level: float) -> tuple[DataFrame, DataFrame]:
    """``vertices(v, x, y, z, winner)`` and ``triangles(t, a, b, c)`` of the surface where the density is ``level``.

    Each cell of eight voxel centres that the surface crosses has a vertex, the mean
    of the crossings of its edges, with the winner of its densest corner; each crossed
    edge joins the four cells around it by two triangles, facing the thin side.
    Voxels that the field does not name have density 0, so surfaces are closed.
    """
    corners = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("k", "dx", "dy", "dz"), (k, k & 1, k >> 1 & 1, k >> 2))]) for k in range(8)])).alias("c")
    spread = field.select("ix", "iy", "iz", "density", "winner", corners)
    at = {a: (F.col(f"i{a}") - F.col(f"c.d{a}")).cast("long").alias(f"c{a}") for a in "xyz"}
    values = [F.coalesce(F.max(F.when(F.col("c.k") == k, F.col("density"))), F.lit(0.0)).alias(f"d{k}") for k in range(8)]
    cells = spread.select(*at.values(), "c", "density", "winner").groupBy("cx", "cy", "cz").agg(*values, F.max(F.struct("density", "winner"))["winner"].alias("winner"))
    inside = [F.col(f"d{k}") >= level for k in range(8)]
    crossed = cells.where(F.greatest(*[f"d{k}" for k in range(8)]) >= level).where(F.least(*[f"d{k}" for k in range(8)]) < level)
    cuts = []
    for p, q in EDGES:
        t = (level - F.col(f"d{p}")) / (F.col(f"d{q}") - F.col(f"d{p}"))
        ends = [((p >> a & 1), (q >> a & 1)) for a in range(3)]
        cuts.append(F.when(inside[p] != inside[q], F.struct(*[(F.lit(float(u)) if u == v else t).alias(n) for n, (u, v) in zip("xyz", ends, strict=True)])))
    met = crossed.withColumn("_cuts", F.array_compact(F.array(*cuts)))
    mean = lambda a: F.aggregate("_cuts", F.lit(0.0), lambda s, c: s + c[a]) / F.size("_cuts")
    own = _number(F.col("cx"), F.col("cy"), F.col("cz"))
    vertices = met.select(own.alias("v"), *[((F.col(f"c{a}") + 0.5 + mean(a)) * spacing).alias(a) for a in "xyz"], "winner")
    quads = []
    for a in range(3):
        b, c = (a + 1) % 3, (a + 2) % 3
        ring = []
        for step in ((0, 0), (1, 0), (1, 1), (0, 1)):
            back = [0, 0, 0]
            back[b], back[c] = step
            ring.append(_number(*[F.col(f"c{n}") - back[i] for i, n in enumerate("xyz")]))
        out = inside[0] & ~inside[1 << a]
        into = ~inside[0] & inside[1 << a]
        face = lambda i, j, k: F.struct(ring[i].alias("a"), ring[j].alias("b"), ring[k].alias("c"))  # noqa: B023, E731
        quads.append(F.when(out, F.array(face(0, 1, 2), face(0, 2, 3))).when(into, F.array(face(0, 2, 1), face(0, 3, 2))))
    triangles = crossed.select(F.explode(F.flatten(F.array_compact(F.array(*quads)))).alias("f")).select(F.concat_ws("/", "f.a", "f.b", "f.c").alias("t"), "f.a", "f.b", "f.c")
    return vertices, triangles
