"""Whole-asset operations: generated clips, static parts, canonical rows, dequantized planes, sweeps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N


def torus(spark: SparkSession, n: int, radius: float = 2.0, tube: float = 0.6) -> DataFrame:
    """``n`` points evenly spread over a torus: two irrational rotations, no randomness, one pass."""
    golden, silver = (math.sqrt(5) - 1) / 2, math.sqrt(2) - 1
    frac = lambda c: c - F.floor(c)
    i = F.col("id").cast("double") + 0.5
    u, v = frac(i * golden) * (2 * math.pi), frac(i * silver) * (2 * math.pi)
    rows = spark.range(n).select(F.col("id").alias("stable_id"), u.alias("u"), v.alias("v"))
    ring = radius + tube * F.cos("v")
    return rows.select("stable_id", (ring * F.cos("u")).alias("x"), (tube * F.sin("v")).alias("y"), (ring * F.sin("u")).alias("z"))


def with_static(dynamic: DataFrame, static: DataFrame, names: Mapping[str, Sequence[str]], start: int) -> DataFrame:
    """Dynamic rows, then static ones numbered from ``start``, whose base columns fill every bank of a track."""
    spread = static.select((F.col("stable_id") + start).alias("stable_id"), *[F.col(base).alias(bank) for base, banks in names.items() for bank in banks], F.lit("static").alias("source_element"))
    return dynamic.withColumn("source_element", F.lit("dynamic")).unionByName(spread, allowMissingColumns=True)


def canonical(points: DataFrame, banks: Mapping[str, str]) -> DataFrame:
    """Base columns from their first bank and zero normals in front of what is stored."""
    return points.select(*[F.col(bank).alias(base) for base, bank in banks.items()], *[F.lit(0.0).alias(n) for n in ("nx", "ny", "nz")], *points.columns)


def dequantize_mean(low8: Column, high8: Column, lowest: float, highest: float) -> Column:
    """A 16-bit plane value on a signed logarithmic scale between two ends."""
    q = (low8 + high8 * 256) / 65_535.0
    return N.signed_expm1(F.lit(lowest) + (highest - lowest) * q)


def sweep(matches: DataFrame, value: Sequence[str], profiles: Mapping[str, Sequence[float]]) -> DataFrame:
    """``(profile, matched)``: rows within each named set of limits, all counted in one pass."""
    ok = {name: [F.abs(c) <= limit for c, limit in zip(value, limits, strict=True)] for name, limits in profiles.items()}
    every = {name: cs[0] if len(cs) == 1 else cs[0] & _and(cs[1:]) for name, cs in ok.items()}
    one = matches.agg(*[F.count_if(c).alias(name) for name, c in every.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("profile"), F.col(n).alias("matched")) for n in profiles])).alias("p")).select("p.*")


def _and(cs: Sequence[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def standing_centre(rays: DataFrame, group: str) -> DataFrame:
    """``(group, x, y, z, n)``: the point closest to all lines (px, py, pz) + t (dx, dy, dz), d of length one.

    Sums of the normal equations are one partial aggregate; each group's 3 x 3 system
    is solved by Cramer's rule. Parallel lines give null.
    """
    a = "xyz"
    m = {(i, j): (1.0 if i == j else 0.0) - F.col(f"d{a[i]}") * F.col(f"d{a[j]}") for i in range(3) for j in range(i, 3)}
    at = lambda i, j: m[min(i, j), max(i, j)]
    aggs = [F.sum(c).alias(f"m{i}{j}") for (i, j), c in m.items()]
    aggs += [F.sum(sum((at(i, j) * F.col(f"p{a[j]}") for j in (1, 2)), at(i, 0) * F.col("px"))).alias(f"r{i}") for i in range(3)]
    s = rays.groupBy(group).agg(*aggs, F.count(F.lit(1)).alias("n"))
    c = lambda i, j: F.col(f"m{min(i, j)}{max(i, j)}")

    def det(columns: list[list[Column]]) -> Column:
        p, q, r = columns
        return p[0] * (q[1] * r[2] - q[2] * r[1]) - q[0] * (p[1] * r[2] - p[2] * r[1]) + r[0] * (p[1] * q[2] - p[2] * q[1])

    cols = [[c(i, j) for i in range(3)] for j in range(3)]
    right = [F.col(f"r{i}") for i in range(3)]
    whole = det(cols)
    safe = F.when(F.abs(whole) > 1e-12, whole)
    return s.select(group, *[(det([right if k == j else cols[k] for k in range(3)]) / safe).alias(a[j]) for j in range(3)], "n")
