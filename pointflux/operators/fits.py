"""Fits and transforms: rigid, similarity and affine motion, harmonic rotation, consensus.

Fits are moments of groups, summed by partial aggregates; only the moments of a
group, a fixed number of values, are solved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _basis(d: np.ndarray, band: int) -> np.ndarray:
    """Real spherical harmonics of one band, up to constant factors of the band."""
    x, y, z = d.T
    if band == 1:
        return np.stack([-y, z, -x], 1)
    if band == 2:
        return np.stack([x * y, -y * z, (2 * z * z - x * x - y * y) / (2 * np.sqrt(3)), -x * z, (x * x - y * y) / 2], 1)
    s = np.sqrt
    return np.stack([
        -s(5 / 8) * y * (3 * x * x - y * y), s(15) * x * y * z, -s(3 / 8) * y * (4 * z * z - x * x - y * y), z * (2 * z * z - 3 * x * x - 3 * y * y) / 2,
        -s(3 / 8) * x * (4 * z * z - x * x - y * y), s(15) / 2 * z * (x * x - y * y), -s(5 / 8) * x * (x * x - 3 * y * y),
    ], 1)


def matrix(q: Sequence[float]) -> np.ndarray:
    w, x, y, z = np.asarray(q, float) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def sh_rotation(q: Sequence[float], band: int, samples: int = 48) -> np.ndarray:
    """The matrix that turns a band's coefficients, by least squares over directions on a spiral."""
    i = np.arange(samples) + 0.5
    z, a = 1 - 2 * i / samples, np.pi * (1 + 5**0.5) * i
    d = np.stack([np.sqrt(1 - z * z) * np.cos(a), np.sqrt(1 - z * z) * np.sin(a), z], 1)
    return np.linalg.lstsq(_basis(d, band), _basis(d @ matrix(q), band), rcond=None)[0]


AXES = ("x", "y", "z")


def moments(pairs: DataFrame, block: str) -> DataFrame:
    """Sums of each block's pairs (x, y, z) to (u, v, w): count, means and products, one partial aggregate."""
    to = ("u", "v", "w")
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(c).alias(f"s_{c}") for c in (*AXES, *to)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}{b}") for a in AXES for b in (*AXES, *to)]
    aggs += [F.sum(F.col("u") ** 2 + F.col("v") ** 2 + F.col("w") ** 2).alias("s_uu")]
    return pairs.groupBy(block).agg(*aggs)


def _fit(m: pd.Series, kind: str) -> tuple[np.ndarray, np.ndarray, float]:
    n = m["n"]
    a, b = np.array([m[f"s_{c}"] for c in "xyz"]) / n, np.array([m[f"s_{c}"] for c in "uvw"]) / n
    cxx = np.array([[m[f"s_{p}{q}"] for q in "xyz"] for p in "xyz"]) / n - np.outer(a, a)
    cxy = np.array([[m[f"s_{p}{q}"] for q in "uvw"] for p in "xyz"]) / n - np.outer(a, b)
    var = m["s_uu"] / n - b @ b
    if kind == "affine":
        lin = np.linalg.lstsq(cxx, cxy, rcond=None)[0].T
    else:
        u, s, vt = np.linalg.svd(cxy)
        sign = np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1])
        lin = (u @ sign @ vt).T
        if kind == "similarity":
            lin = lin * ((s * np.diag(sign)).sum() / max(np.trace(cxx), 1e-12))
    err = var - 2 * np.trace(lin @ cxy) + np.trace(lin @ cxx @ lin.T)
    return lin, b - lin @ a, float(np.sqrt(max(err, 0.0)))


def fit_blocks(pairs: DataFrame, block: str, kind: str = "rigid") -> DataFrame:
    """``(block, n, m00..m22, tx, ty, tz, rmse)``: each block's best rigid, similarity or affine motion."""
    names = [f"m{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz", "rmse"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, m in pdf.iterrows():
                lin, shift, rmse = _fit(m, kind)
                out.append((int(m[block]), int(m["n"]), *lin.ravel(), *shift, rmse))
            yield pd.DataFrame(out, columns=[block, "n", *names])

    return moments(pairs, block).mapInPandas(run, f"{block} long, n long, " + ", ".join(f"{n} double" for n in names))


def quantized(fits: DataFrame, bits: int) -> DataFrame:
    """Fits with their parameters in steps of 2**-bits, as they are stored."""
    step = float(1 << bits)
    return fits.withColumns({c: F.floor(F.col(c) * step + 0.5) / step for c in fits.columns if c[0] in "mt" and c[1:] in ("x", "y", "z", *[f"{i}{j}" for i in range(3) for j in range(3)])})


def grid_scatter(points: DataFrame, values: Sequence[str], size: float, axes: Sequence[str] = AXES) -> DataFrame:
    """Trilinear scatter onto grid nodes: ``(node..., weight, values...)`` as weighted means."""
    corners = F.array(*[F.struct(*[F.lit((c >> i) & 1).alias(a) for i, a in enumerate(axes)]) for c in range(1 << len(axes))])
    cell = {a: F.floor(F.col(a) / size) for a in axes}
    rows = points.select(*axes, *values, F.explode(corners).alias("_c"))
    frac = lambda a: F.col(a) / size - cell[a]
    weight = F.lit(1.0)
    for a in axes:
        weight = weight * F.when(F.col(f"_c.{a}") == 1, frac(a)).otherwise(1 - frac(a))
    rows = rows.select(*[(cell[a] + F.col(f"_c.{a}")).alias(f"n{a}") for a in axes], weight.alias("_w"), *values).where("_w > 0")
    return rows.groupBy(*[f"n{a}" for a in axes]).agg(F.sum("_w").alias("weight"), *[(F.sum(F.col("_w") * F.col(v)) / F.sum("_w")).alias(v) for v in values])


def consensus(views: DataFrame, group: str, weight: str, angle_degrees: float = 55.0) -> DataFrame:
    """The direction most of a group's views agree on: ``(group, x, y, z, inliers, dominance)``.

    ``views(group, view, x, y, z, weight)`` are a few observations of one pose set. The
    seed with the largest inlier weight counts, the first of equals; then the weighted
    mean of its inliers.
    """
    limit = float(np.cos(np.radians(angle_degrees)))
    lists = views.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("view", "x", "y", "z", F.col(weight).alias("w")))).alias("v"))
    close = lambda a, b: a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] >= limit
    score = F.transform("v", lambda a: F.aggregate(F.filter("v", lambda b: close(a, b)), F.lit(0.0), lambda s, b: s + b["w"]))
    rows = lists.withColumn("scores", score).withColumn("seed", F.get("v", (F.array_position("scores", F.array_max("scores")) - 1).cast("int")))
    rows = rows.withColumn("in", F.filter("v", lambda b: close(F.col("seed"), b)))
    total = lambda f: F.aggregate("in", F.lit(0.0), lambda s, b: s + f(b))
    sums = rows.select(group, F.size("in").alias("inliers"), *[total(lambda b, a=a: b["w"] * b[a]).alias(f"s{a}") for a in AXES], (F.array_max("scores") / F.aggregate("v", F.lit(0.0), lambda s, b: s + b["w"])).alias("dominance"))
    size = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2)
    safe = F.when(size > 1e-12, size)
    return sums.select(group, *[(F.col(f"s{a}") / safe).alias(a) for a in AXES], "inliers", "dominance")


#: Least numbers of views, dominance and confidence of a verdict.
DIRECTION, CENTRE, SEMANTIC = (6, 0.56, 0.34), (4, 0.28), (2, 0.65)


def verdict(views: str, dominance: str, confidence: str) -> F.Column:
    v, d, c = F.col(views), F.col(dominance), F.col(confidence)
    return F.when((v >= DIRECTION[0]) & (d >= DIRECTION[1]) & (c >= DIRECTION[2]), "direction").when((v >= CENTRE[0]) & (c >= CENTRE[1]), "centre").when((v >= SEMANTIC[0]) & (d >= SEMANTIC[1]), "semantic").otherwise("rejected")
