"""Order, samples, levels of detail and dense numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import numeric as N
from ..storage import stage


def morton_of(x: Column, y: Column, z: Column, centre: Sequence[float], half: float) -> Column:
    return B.morton(B.cell10(x, centre[0], half), B.cell10(y, centre[1], half), B.cell10(z, centre[2], half))


def by_ranges(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``rows`` sorted by ranges and written: ``_part`` is a row's range, ``_at`` grows inside it.

    Ranges are cut at sampled quantiles, so outliers and crowded values leave them
    even; rows equal in all of ``order`` share one.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")


def dense_ids(rows: DataFrame, order: Sequence[str | Column], name: str = "dense_id") -> DataFrame:
    """Number rows from 0 in ``order`` without gathering them in one task: each range is numbered alone, from where those before it end."""
    placed = by_ranges(rows, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))  # a row for each range
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", "_low", start.alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") - F.col("_low")).drop("_part", "_at", "_low", "_start")


def ranked_values(rows: DataFrame, value: str) -> DataFrame:
    """``(v, m, first)``: each finite value once, how often it occurs and the rank of its first occurrence."""
    counted = rows.where(N.finite(F.col(value))).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    placed = by_ranges(counted, ["v"])
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = placed.groupBy("_part").agg(F.sum("m").alias("_n"))  # a row for each range
    starts = totals.select("_part", before("_n", Window.orderBy("_part")).alias("_start"))
    inside = placed.withColumn("_in", before("m", Window.partitionBy("_part").orderBy("v")))
    return stage(inside.join(F.broadcast(starts), "_part").select("v", "m", (F.col("_start") + F.col("_in")).alias("first")), "ranked")


def morton_layout(tracks: DataFrame, code: str = "code", birth: str = "birth", track: str = "track") -> DataFrame:
    """New dense ids by (Morton code, birth segment, track id)."""
    return dense_ids(tracks, [code, birth, track])


def visibility(opacity: Column, s0: Column, s1: Column, s2: Column) -> Column:
    """Opacity times the area of the two largest scales, log scales clamped to [-16, 2]."""
    c = [N.clamp(s, -16.0, 2.0) for s in (s0, s1, s2)]
    return N.sigmoid(opacity) * F.exp(c[0] + c[1] + c[2] - F.least(*c))


def top_fraction(rows: DataFrame, score: str, fraction: float, tie: str) -> DataFrame:
    """The best ``round(n * fraction)`` rows; a top-k with ties by id. ``n`` is one count."""
    k = int(rows.count() * fraction + 0.5)
    return rows.orderBy(F.desc(score), tie).limit(k)


def even_sample(rows: DataFrame, dense: str, n: int, m: int) -> DataFrame:
    """The rows at floor((i + 0.5) n / m), i = 0..m-1, of ``n`` densely numbered ones; a filter, no shuffle."""
    if m >= n:
        return rows
    i = F.ceil(F.col(dense) * m / n - 0.5)
    first = F.floor((i + 0.5) * n / m)
    return rows.where((i < m) & (first == F.col(dense)))


def preview(rows: DataFrame, dense: str, n: int, m: int, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """An even sample and the six extreme points (ties by lower id)."""
    ends = rows.agg(*[f(F.struct(*rows.columns), F.struct(F.col(a), sign * F.col(dense))).alias(f"{a}{k}") for a in axes for k, (f, sign) in enumerate(((F.min_by, 1), (F.max_by, -1)))])
    extremes = ends.select(F.explode(F.array(*ends.columns)).alias("e")).select("e.*")
    return even_sample(rows, dense, n, m).union(extremes).dropDuplicates([dense])


def blocks(rows: DataFrame, slot: str, size: int = 256) -> DataFrame:
    """Contiguous runs of ``size`` slots: ``(block, first_slot, last_slot, n)``."""
    return rows.groupBy(F.floor(F.col(slot) / size).alias("block")).agg(F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"), F.count(F.lit(1)).alias("n"))


def tiers(rows: DataFrame, score: str, tie: str, fractions: Sequence[float]) -> DataFrame:
    """``tier`` of each row by cumulative fractions of the order by score descending, tie ascending."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    ranked = dense_ids(rows, [F.col(score).desc(), F.col(tie).asc()], "_rank").crossJoin(F.broadcast(n))
    tier = F.lit(0)
    for f in fractions:
        tier = tier + F.when(F.col("_rank") >= F.floor(F.col("_n") * f + 0.5), 1).otherwise(0)
    return ranked.withColumn("tier", tier.cast("int")).drop("_n", "_rank")
