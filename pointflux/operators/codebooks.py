"""Codebooks, assignment and bounded-error exceptions.

A codebook is a fixed number of values and lives in the plan as literals; rows
never gather anywhere. Training works on sums by code, one partial aggregate a
round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .stats import quantiles


def nearest_scalar(value: Column, codes: Sequence[float]) -> Column:
    """Index of the nearest code, the lower at equal distance; codes ascend."""
    cuts = [(a + b) / 2 for a, b in zip(codes, codes[1:])]
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(value > c, 1).otherwise(0)
    return out


def scalar_codebook(rows: DataFrame, value: str, bits: int, rounds: int = 6) -> list[float]:
    """2**bits codes: quantiles first, then ``rounds`` of means by nearest code; an empty code stays."""
    k = 1 << bits
    good = rows.where(N.finite(F.col(value))).select(F.col(value).cast("double").alias("v"))
    start = quantiles(good, "v", [(i + 0.5) / k for i in range(k)])
    codes = sorted(start or [0.0] * k)
    for _ in range(rounds):
        means = good.groupBy(nearest_scalar(F.col("v"), codes).alias("c")).agg(F.avg("v").alias("m")).collect()  # a row a code
        new = list(codes)
        for r in means:
            new[r["c"]] = r["m"]
        codes = sorted(new)
    return codes


def squared_distance(v: Column, code: Sequence[float]) -> Column:
    fixed = F.array(*[F.lit(float(c)) for c in code])
    return F.aggregate(F.zip_with(v, fixed, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def assign(rows: DataFrame, vector: str, codes: Sequence[Sequence[float]], label: str = "code") -> DataFrame:
    """``code`` and ``d2``: nearest of a fixed number of codes, the first of equals."""
    each = F.array(*[F.struct(squared_distance(F.col(vector), c).alias("d2"), F.lit(i).alias("c")) for i, c in enumerate(codes)])
    return rows.withColumn("_best", F.array_min(each)).withColumns({label: F.col("_best.c"), "d2": F.col("_best.d2")}).drop("_best")


def kmeans(rows: DataFrame, vector: str, seeds: Sequence[Sequence[float]], rounds: int = 5) -> list[list[float]]:
    """Lloyd's algorithm from given seeds for a fixed number of rounds; an empty cluster keeps its centre."""
    codes, dim = [list(map(float, s)) for s in seeds], len(seeds[0])
    for _ in range(rounds):
        sums = assign(rows, vector, codes).groupBy("code").agg(*[F.avg(F.get(vector, F.lit(i))).alias(f"m{i}") for i in range(dim)]).collect()  # a row a cluster
        for r in sums:
            codes[r["code"]] = [r[f"m{i}"] for i in range(dim)]
    return codes


def seed_index(clusters: int, n: int, seed: int = 0) -> list[int]:
    """Rows that seed clusters: (c * 7919 + seed * 104729) mod n."""
    return [(c * 7919 + seed * 104_729) % n for c in range(clusters)]


def exceptions(rows: DataFrame, error: str, most: float, rmse: float, bins: int = 4096) -> DataFrame:
    """``repair``: errors above ``most`` always, then the highest bins until the rest's RMSE is ``rmse``.

    Bins of the error are counted once; the cut is found on their running sums (a
    row a bin) and joined back as one value.
    """
    e = F.col(error)
    at = F.least(F.lit(bins - 1), F.floor(e / most * bins)).cast("int")
    low = rows.where(e <= most).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("s"))
    total = rows.agg(F.count(F.lit(1)).alias("all"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cut = low.withColumn("run", F.sum("s").over(upto)).crossJoin(F.broadcast(total)).where(F.sqrt(F.col("run") / F.col("all")) <= rmse).agg(F.coalesce(F.max("b"), F.lit(-1)).alias("_cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("repair", (e > most) | (at > F.col("_cut"))).drop("_cut")


def hash_grid(rows: DataFrame, values: Sequence[str], axes: Sequence[str], size: float, capacity: int) -> DataFrame:
    """Values less the rounded mean of their hashed cell: one level of residual prediction."""
    primes = (73_856_093, 19_349_663, 83_492_791)  # fixed values
    h = F.lit(0).cast("long")
    for a, p in zip(axes, primes):
        h = h.bitwiseXOR(F.floor(F.col(a) / size) * p)
    placed = rows.withColumn("bucket", F.pmod(h, F.lit(capacity)))
    means = placed.groupBy("bucket").agg(*[N.js_round(F.avg(v)).alias(f"_{v}") for v in values])
    return placed.join(means, "bucket").select(*[c for c in placed.columns if c not in values], *[(F.col(v) - F.col(f"_{v}")).alias(v) for v in values])


Tree = dict[int, tuple[Sequence[float], Sequence[float]]]

#: Rows that a tree is fitted on, at most.
TREE_SAMPLE = 32_768


def _steps(x: np.ndarray, tree: Tree, depth: int) -> np.ndarray:
    """Heap numbers that rows reach after ``depth`` steps."""
    at = np.ones(len(x), np.int64)
    for _ in range(depth):
        nodes, place = np.unique(at, return_inverse=True)
        left, right = (np.array([tree[n][k] if n in tree else np.zeros(x.shape[1]) for n in nodes.tolist()], float)[place] for k in (0, 1))
        at = 2 * at + (((x - right) ** 2).sum(1) < ((x - left) ** 2).sum(1))
    return at


def descend(vector: Column, tree: Tree, depth: int) -> Column:
    """Leaf (1-based heap number) reached by going to the nearer of two codes at each node, the first of equals; left where a node has none."""

    @F.pandas_udf("int")
    def leaf(v: pd.Series) -> pd.Series:
        return pd.Series(_steps(np.stack(v.to_numpy()).astype(float), tree, depth) if len(v) else [], dtype="int32")

    return leaf(vector)


def tree_codebook(rows: DataFrame, vector: str, depth: int, rounds: int = 5, spread: float = 1e-2, most: int = TREE_SAMPLE) -> Tree:
    """A binary tree of codes: each node's rows are split by two-means from its mean, nudged both ways.

    Fitted on the ``most`` rows smallest by hash; a side that gets no rows keeps its code.
    """
    found = rows.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector), vector).limit(most).toPandas()[vector]
    tree: Tree = {}
    if not len(found):
        return tree
    x = np.stack(found.to_numpy()).astype(float)
    at = np.ones(len(x), np.int64)
    for _ in range(depth):
        sides = np.zeros(len(x), np.int64)
        for node in np.unique(at).tolist():
            own = np.flatnonzero(at == node)
            codes = [x[own].mean(0) - spread, x[own].mean(0) + spread]
            side = lambda: ((x[own] - codes[1]) ** 2).sum(1) < ((x[own] - codes[0]) ** 2).sum(1)  # noqa: B023, E731
            for _ in range(rounds):
                right = side()
                codes = [x[own[~right]].mean(0) if (~right).any() else codes[0], x[own[right]].mean(0) if right.any() else codes[1]]
            tree[node] = (codes[0].tolist(), codes[1].tolist())
            sides[own] = side()
        at = 2 * at + sides
    return tree


def pursue(rows: DataFrame, vector: str, atoms: Sequence[Sequence[float]], active: int) -> DataFrame:
    """Greedy sparse code over unit atoms: ``picks`` as (atom, weight) and the ``residual``'s squared size.

    Each step takes the atom with the largest inner product, the first of equals.
    """
    out = rows.withColumns({"_r": F.col(vector), "picks": F.array().cast("array<struct<atom:int,weight:double>>")})
    dot = lambda a: F.aggregate(F.zip_with("_r", F.array(*[F.lit(float(v)) for v in a]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    book = F.array(*[F.array(*[F.lit(float(v)) for v in a]) for a in atoms])
    for _ in range(active):
        best = F.array_max(F.array(*[F.struct(F.abs(dot(a)).alias("size"), F.lit(-i).alias("minus"), dot(a).alias("w")) for i, a in enumerate(atoms)]))
        out = out.withColumn("_b", best)
        out = out.withColumn("picks", F.concat("picks", F.array(F.struct((-F.col("_b.minus")).alias("atom"), F.col("_b.w").alias("weight")))))
        out = out.withColumn("_r", F.zip_with("_r", F.get(book, -F.col("_b.minus")), lambda x, y: x - F.col("_b.w") * y))
    return out.withColumn("residual", F.aggregate("_r", F.lit(0.0), lambda s, x: s + x * x)).drop("_r", "_b")
