"""Aggregates: histograms, bounds, health audits and repairs, error and entropy statistics."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .layout import ranked_values

METRICS = ("opacity", "scale_max", "volume", "x", "y", "z", "distance", "lifetime_center", "lifetime_width")


def metric(name: str, scale: Sequence[Column] = ()) -> Column:
    """A per-point metric over columns x, y, z, mu, w, alpha and log scales."""
    if name in "xyz":
        return F.col(name)
    return {
        "opacity": lambda: F.col("alpha"),
        "scale_max": lambda: F.greatest(*[F.exp(s) for s in scale]),
        "volume": lambda: F.exp(sum(scale[1:], scale[0])),
        "distance": lambda: F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2),
        "lifetime_center": lambda: F.col("mu"),
        "lifetime_width": lambda: F.col("w"),
    }[name]()


def temporal_aggregate(samples: DataFrame, value: Column, keys: Sequence[str], visible_only: bool, alpha: str = "alpha") -> DataFrame:
    """Minimum, mean and maximum of each point's finite values over frames."""
    use = N.finite(value) & ((F.col(alpha) >= 0.01) if visible_only else F.lit(True))
    v = F.when(use, value)
    out = samples.groupBy(*keys).agg(F.min(v).alias("minimum"), F.avg(v).alias("mean"), F.max(v).alias("maximum"), F.count(v).alias("n"))
    return out.where("n > 0")


def histogram(values: DataFrame, value: str, bins: int = 48) -> DataFrame:
    """Equi-width bins ``(bin, low, high, count)`` over finite values.

    16 to 96 bins; equal ends are padded by 5 % or 0.5; the last bin is closed; no
    values give empty bins over [0, 1]. Two aggregates over the values: the range
    (one row, broadcast) and the counts (a row for each bin).
    """
    bins = max(16, min(96, bins))
    good = values.where(N.finite(F.col(value))).select(F.col(value).alias("v"))
    ends = good.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    pad = F.when(F.col("a") == F.col("b"), F.greatest(F.lit(0.5), F.abs("a") * 0.05)).otherwise(0.0)
    ends = ends.select(F.coalesce(F.col("a") - pad, F.lit(0.0)).alias("lo"), F.coalesce(F.col("b") + pad, F.lit(1.0)).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    counts = good.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    frame = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    return frame.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("count"))


def bounds(points: DataFrame, axes: Sequence[str] = ("x", "y", "z"), strict: bool = False, eps: float = 1e-4) -> DataFrame:
    """Axis-aligned box over finite positions; ``strict`` fails on any other, empty boxes are [-1, 1]."""
    ok = [N.finite(F.col(a)) for a in axes]
    every = ok[0]
    for o in ok[1:]:
        every = every & o
    bad = F.count_if(~every)
    out = points.agg(bad.alias("skipped"), *[f(F.when(every, F.col(a))).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])
    if strict:
        return out.withColumn("skipped", F.when(F.col("skipped") > 0, F.raise_error(F.lit("a position is not finite"))).otherwise(F.col("skipped")))
    cols = ["skipped"]
    for a in axes:
        low, high = F.coalesce(f"min_{a}", F.lit(-1.0)), F.coalesce(f"max_{a}", F.lit(1.0))
        flat = high - low < eps
        cols += [F.when(flat, low - eps).otherwise(low).alias(f"min_{a}"), F.when(flat, high + eps).otherwise(high).alias(f"max_{a}")]
    return out.select(*cols)


#: The 26 directions to the neighbours of a cube, as unit vectors.
DIRECTIONS = [tuple(c / math.sqrt(sum(v * v for v in d)) for c in d) for d in itertools.product((-1, 0, 1), repeat=3) if any(d)]


def support(points: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """The largest extent along each of 26 directions: ``(direction, support)``, one aggregate."""
    maxima = points.agg(*[F.max(F.col(x) * a + F.col(y) * b + F.col(z) * c).alias(f"d{i}") for i, (a, b, c) in enumerate(DIRECTIONS)])
    return maxima.select(F.posexplode(F.array(*[f"d{i}" for i in range(len(DIRECTIONS))])).alias("direction", "support"))


def envelope(support_values: Sequence[float]) -> tuple[list[tuple[float, float, float]], list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Vertices, outward triangles and edges of the polytope with 26 support planes; works on 26 numbers, no rows.

    Planes move out by 0.0015 of the bounding box's diagonal, 1e-5 at least.
    """
    import numpy as np

    d, h = np.array(DIRECTIONS), np.array(support_values, float)
    at = {tuple(np.rint(v)): x for v, x in zip(d, h, strict=True) if np.abs(v).max() > 1 - 1e-9}
    size = math.hypot(*(at[e] + at[tuple(-c for c in e)] for e in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))))
    h, close = h + max(1e-5, 0.0015 * size), max(1e-8, max(size, 1e-4) * 1e-6)
    found: list[np.ndarray] = []
    for tri in itertools.combinations(range(len(d)), 3):
        m = d[list(tri)]
        if abs(np.linalg.det(m)) > 1e-9:
            p = np.linalg.solve(m, h[list(tri)])
            if (d @ p <= h + 4 * close).all() and not any(np.linalg.norm(p - q) <= 4 * close for q in found):
                found.append(p)
    triangles, edges = [], set()
    for k in range(len(d)):
        on = [i for i, p in enumerate(found) if abs(d[k] @ p - h[k]) <= 8 * close]
        if len(on) >= 3:
            centre = np.mean([found[i] for i in on], axis=0)
            u = np.cross([0.0, 1.0, 0.0] if abs(d[k][1]) < 0.9 else [1.0, 0.0, 0.0], d[k])
            v = np.cross(d[k], u)
            on.sort(key=lambda i: math.atan2((found[i] - centre) @ v / np.linalg.norm(v), (found[i] - centre) @ u / np.linalg.norm(u)))
            triangles += [(on[0], on[i], on[i + 1]) for i in range(1, len(on) - 1)]
            edges |= {(min(p, q), max(p, q)) for p, q in zip(on, on[1:] + on[:1], strict=True)}
    return [tuple(map(float, p)) for p in found], triangles, sorted(edges)


#: What the audit accepts.
QUAT_TOLERANCE, SCALE_RANGE, OPACITY_RANGE = 0.02, (-20.0, 10.0), (-20.0, 20.0)


def health(rows: DataFrame) -> DataFrame:
    """Counts by issue code over x, y, z, qw..qz, scale, opacity, mu, w: ``(code, count)``, one aggregate.

    A scale that is not a number counts both as not finite and out of range.
    """
    finite = lambda *c: ~_all([N.finite(F.col(n)) for n in c])
    length = F.sqrt(sum((F.col(f"q{n}") ** 2 for n in "xyz"), F.col("qw") ** 2))
    logit_ok = N.finite(F.col("opacity")) | (F.col("opacity") == N.NEG_INF)
    issues = {
        "nonfinite-position": finite("x", "y", "z"),
        "nonfinite-rotation": finite("qw", "qx", "qy", "qz"),
        "nonfinite-scale": finite("scale"),
        "nonfinite-opacity": ~logit_ok,
        "quaternion-length": ~finite("qw", "qx", "qy", "qz") & (F.abs(length - 1) > QUAT_TOLERANCE),
        "scale-range": ~F.coalesce(F.col("scale").between(*SCALE_RANGE) & ~F.isnan("scale"), F.lit(False)),
        "opacity-range": N.finite(F.col("opacity")) & ~F.col("opacity").between(*OPACITY_RANGE),
        "lifetime": finite("mu", "w") | F.coalesce(F.col("w") < 0, F.lit(False)),
    }
    one = rows.agg(*[F.count_if(c).alias(n) for n, c in issues.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("code"), F.col(f"`{n}`").alias("count")) for n in issues])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def repair_keys(keys: DataFrame, value: str, fallback: float, track: str = "track", k: str = "k") -> DataFrame:
    """Replace values that are not finite by the nearest finite key's, the earlier at equal distance, else ``fallback``."""
    before = Window.partitionBy(track).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(track).orderBy(k).rowsBetween(0, Window.unboundedFollowing)
    good = F.when(N.finite(F.col(value)), F.struct(F.col(k).alias("k"), F.col(value).alias("v")))
    rows = keys.withColumns({"_b": F.last(good, True).over(before), "_a": F.first(good, True).over(after)})
    nearer = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col(k) - F.col("_b.k") <= F.col("_a.k") - F.col(k), F.col("_b.v")).otherwise(F.col("_a.v"))
    return rows.withColumn(value, F.coalesce(nearer, F.lit(fallback))).drop("_b", "_a")


def repair_scalar(value: Column, low: float, high: float, nan: float) -> Column:
    """Infinities become the ends of the range, NaN a fixed value, the rest is clamped."""
    return F.when(F.isnan(value), nan).otherwise(N.clamp(value, low, high))


def merge_reports(reports: DataFrame) -> DataFrame:
    """Sum counts by code; the first report's label and severity stay."""
    return reports.groupBy("code").agg(F.sum("count").alias("count"), F.min_by("label", "report").alias("label"), F.min_by("severity", "report").alias("severity"))


def invisible(keys: DataFrame, track: str = "track") -> DataFrame:
    """Tracks whose every opacity key is minus infinity and whose keys and lifetime are sound."""
    agg = keys.groupBy(track).agg(F.bool_and(F.col("opacity") == N.NEG_INF).alias("none"), F.bool_and(N.finite(F.col("frame")) & (F.col("w") >= 0)).alias("sound"), (F.count_distinct("frame") == F.count("frame")).alias("rising"))
    return agg.where("none and sound and rising").select(track)


def error_stats(rows: DataFrame, a: str, b: str, sets: Sequence[str], where: str) -> DataFrame:
    """Value errors of ``b`` against ``a`` over grouping sets of ``sets`` and overall.

    Counts, bit-exact counts, mean absolute, root mean square, signed mean and
    largest error with the row ``where`` it occurs.
    """
    err = F.col(b) - F.col(a)
    ok = N.finite(err)
    e = F.when(ok, err)
    aggs = [
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_finite"), F.count_if(F.col(a) == F.col(b)).alias("n_exact"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("worst"),
        F.max_by(F.col(where), F.struct(F.abs(e), -F.col(where))).alias("worst_at"),
    ]
    return rows.groupingSets([*[[F.col(s)] for s in sets], []], *[F.col(s) for s in sets]).agg(*aggs)


def log_histogram(rows: DataFrame, value: str, per_decade: int = 20, low: float = 1e-12, high: float = 1e2) -> DataFrame:
    """Counts by logarithmic bin, -1 for zero; bins are clamped to [low, high]."""
    last = round(math.log10(high / low) * per_decade) - 1
    v = F.col(value)
    at = F.floor((F.log10(F.greatest(v, F.lit(low))) - math.log10(low)) * per_decade + 1e-9)
    return rows.where(N.finite(v)).groupBy(F.when(v == 0, -1).otherwise(F.least(F.lit(last), at)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def quantile_bound(hist: DataFrame, p: float, per_decade: int = 20, low: float = 1e-12) -> DataFrame:
    """The upper bound of the bin that holds the ceil(n p)-th value; the histogram has a few hundred rows."""
    upto = F.sum("count").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("count").over(Window.partitionBy())
    hit = hist.select("bin", upto.alias("upto"), total.alias("n")).where(F.col("upto") >= F.ceil(F.col("n") * p)).agg(F.min("bin").alias("bin"))
    return hit.select("bin", F.when(F.col("bin") < 0, 0.0).otherwise(low * F.pow(F.lit(10.0), (F.col("bin") + 1) / per_decade)).alias("bound"))


def nearest_rank(rows: DataFrame, value: str, ps: Sequence[float]) -> DataFrame:
    """Order statistics at round(p (n - 1)), half up: ``(p, value)``.

    Values are counted once each and ranked range by range, so neither outliers
    nor repeated values gather rows in a task.
    """
    ranked = ranked_values(rows, value)
    n = ranked.agg(F.sum("m").alias("n"))
    wanted = n.select(F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.floor(F.lit(float(p)) * (F.col("n") - 1) + 0.5).alias("k")) for p in ps])).alias("w")).select("w.*")
    hit = (F.col("first") <= F.col("k")) & (F.col("k") < F.col("first") + F.col("m"))
    return ranked.join(F.broadcast(wanted), hit).select("p", F.col("v").alias("value"))  # a row for each p


def quantiles(rows: DataFrame, value: str, ps: Sequence[float]) -> list[float] | None:
    """Quantiles of the finite values, interpolated between ranks; null without values."""
    ranked = ranked_values(rows, value)
    n = ranked.agg(F.sum("m")).first()[0]
    if not n:
        return None
    ranks = sorted({k for p in ps for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    wanted = rows.sparkSession.createDataFrame([(k,) for k in ranks], "k long")
    at = {r["k"]: r["v"] for r in ranked.join(F.broadcast(wanted), (F.col("first") <= F.col("k")) & (F.col("k") < F.col("first") + F.col("m"))).collect()}  # two rows for each p
    out = []
    for p in ps:
        low, part = math.floor(p * (n - 1)), p * (n - 1) - math.floor(p * (n - 1))
        out.append(at[low] + (at[math.ceil(p * (n - 1))] - at[low]) * part)
    return out


def entropy(rows: DataFrame, symbol: Column, by: Sequence[Column] = ()) -> DataFrame:
    """Shannon entropy in bits a value, with counts and range; two partial aggregates."""
    names = [f"_b{i}" for i in range(len(by))]
    counts = rows.groupBy(*[b.alias(n) for b, n in zip(by, names)], symbol.alias("s")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    total = F.sum("c")
    return counts.groupBy(*names).agg((F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total).alias("bits"), total.cast("long").alias("n"), F.count(F.lit(1)).alias("symbols"), F.min("s").alias("lowest"), F.max("s").alias("highest"))


def top_symbols(rows: DataFrame, symbol: Sequence[str], k: int = 254) -> DataFrame:
    """The ``k`` most frequent symbols, ties by key; a top-k, not a sort of all."""
    return rows.groupBy(*symbol).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *symbol).limit(k)
