"""Regions, selection algebra and soft deletes over points and edit tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N

#: Smallest drag, edge tolerance and visibility threshold.
MIN_DRAG = 4.0
EDGE = 0.75
VISIBLE = 0.01


def normalize_rect(x0: float, y0: float, x1: float, y1: float, least: float = MIN_DRAG) -> tuple[float, float, float, float]:
    """Corners in order; a side shorter than ``least`` grows about its centre."""
    out = []
    for a, b in ((x0, x1), (y0, y1)):
        low, high = min(a, b), max(a, b)
        if high - low < least:
            mid = (low + high) / 2
            low, high = mid - least / 2, mid + least / 2
        out.append((low, high))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def in_rect(x: Column, y: Column, rect: Sequence[float]) -> Column:
    return x.between(rect[0], rect[2]) & y.between(rect[1], rect[3])


def resample_path(path: Sequence[tuple[float, float]], radius: float) -> list[tuple[float, float]]:
    """Points along a brush path, at most max(2, 0.4 r) apart."""
    step, out = max(2.0, 0.4 * radius), [tuple(map(float, path[0]))]
    for (ax, ay), (bx, by) in zip(path, path[1:]):
        n = max(1, math.ceil(math.hypot(bx - ax, by - ay) / step))
        out += [(ax + (bx - ax) * k / n, ay + (by - ay) * k / n) for k in range(1, n + 1)]
    return out


def in_brush(x: Column, y: Column, path: Sequence[tuple[float, float]], radius: float) -> Column:
    """Within ``radius`` (2 at least) of a sample of the path; the bounding box is tested first."""
    radius = max(2.0, radius)
    samples = resample_path(path, radius)
    xs, ys = [p[0] for p in samples], [p[1] for p in samples]
    box = x.between(min(xs) - radius, max(xs) + radius) & y.between(min(ys) - radius, max(ys) + radius)
    array = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in samples])
    near = F.exists(array, lambda s: (s["x"] - x) * (s["x"] - x) + (s["y"] - y) * (s["y"] - y) <= radius * radius)
    return box & near


def in_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule; edges within 0.75 count as inside; fewer than three corners hold nothing."""
    if len(corners) < 3:
        return F.lit(False)
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    box = x.between(min(xs) - EDGE, max(xs) + EDGE) & y.between(min(ys) - EDGE, max(ys) + EDGE)
    crossings, near = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
        dx, dy = float(bx - ax), float(by - ay)
        if dy:
            cuts = ((F.lit(float(ay)) > y) != (F.lit(float(by)) > y)) & (x < dx * (y - ay) / dy + ax)
            crossings = crossings + F.when(cuts, 1).otherwise(0)
        size = dx * dx + dy * dy
        t = N.clamp(((x - ax) * dx + (y - ay) * dy) / size, 0.0, 1.0) if size else F.lit(0.0)
        ex, ey = x - (ax + t * dx), y - (ay + t * dy)
        near = near | (ex * ex + ey * ey <= EDGE * EDGE)
    return box & ((crossings % 2 == 1) | near)


def in_cylinder(x: Column, y: Column, z: Column, cx: float, cz: float, radius: float, height: float, pad: float = 0.0) -> Column:
    """Upright cylinder: -pad <= y <= height around (cx, cz); points that are not finite are outside."""
    radius, height, pad = max(1e-3, radius), max(1e-3, height), max(0.0, pad)
    inside = (y >= -pad) & (y <= height) & ((x - cx) * (x - cx) + (z - cz) * (z - cz) <= radius * radius)
    return N.finite(x) & N.finite(y) & N.finite(z) & inside


def project(x: Column, y: Column, z: Column, eye: Sequence[float], right: Sequence[float], up: Sequence[float], forward: Sequence[float], focal: float, width: float, height: float) -> tuple[Column, Column, Column]:
    """Screen position and depth of a world position."""
    d = (x - eye[0], y - eye[1], z - eye[2])
    along = lambda axis: d[0] * axis[0] + d[1] * axis[1] + d[2] * axis[2]
    depth = along(forward)
    safe = F.when(F.abs(depth) < 1e-12, 1e-12).otherwise(depth)
    return width / 2 + focal * along(right) / safe, height / 2 - focal * along(up) / safe, depth


def mode_of(shift: bool = False, ctrl: bool = False, alt: bool = False) -> str:
    """Selection mode of modifier keys: remove before toggle before add before replace."""
    return "remove" if alt else "toggle" if ctrl else "add" if shift else "replace"


def select(edits: DataFrame, ids: DataFrame, mode: str, key: Sequence[str] = ("segment_id", "stable_id")) -> DataFrame:
    """``edits`` after a selection of ``ids``; an id that is named twice toggles twice."""
    named = ids.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    new = {
        "replace": n > 0,
        "add": F.col("selected") | (n > 0),
        "remove": F.col("selected") & (n == 0),
        "toggle": F.col("selected") != (n % 2 == 1),
    }[mode]
    return edits.join(named, list(key), "left").withColumn("selected", new & ~F.col("deleted")).drop("_n")


def invert(edits: DataFrame) -> DataFrame:
    """Select what is neither deleted nor selected."""
    return edits.withColumn("selected", ~F.col("deleted") & ~F.col("selected"))


def delete_selected(edits: DataFrame) -> DataFrame:
    """Soft-delete the selection and clear it; ``newly`` marks what this step deleted."""
    newly = F.col("selected") & ~F.col("deleted")
    return edits.withColumns({"newly": newly, "deleted": F.col("deleted") | F.col("selected"), "selected": F.lit(False)})


def selected_ids(edits: DataFrame, include_deleted: bool = False) -> DataFrame:
    return edits.where(F.col("selected") & (F.lit(include_deleted) | ~F.col("deleted")))


def latest(log: DataFrame, key: Sequence[str], order: str = "op_seq") -> DataFrame:
    """State after an append-only log of edits: each key's row with the highest number.

    Undo drops the highest numbers before this, redo puts them back.
    """
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(*key, "_s.*")


def keep_shape(points: DataFrame, hit: Column, eligible: Column, inside: bool) -> DataFrame:
    """Keep the points inside (or outside) a shape: the eligible rest is deleted."""
    drop = eligible & (~hit if inside else hit)
    return points.withColumn("deleted", F.col("deleted") | F.coalesce(drop, F.lit(False)))


def tracks_inside(keys: DataFrame, inside: Column, track: str = "track") -> DataFrame:
    """Tracks of which every key is inside."""
    return keys.groupBy(track).agg(F.bool_and(inside).alias("all_in"), F.bool_or(inside).alias("any_in"), F.count(F.lit(1)).alias("n_keys"))


def attribute(points: DataFrame, values: DataFrame, name: str, key: Sequence[str], dense: bool, page: int = 65_536) -> DataFrame:
    """Attach a user attribute. Sparse: missing is null. Dense: missing is 0 once its page holds a value."""
    joined = points.join(values.select(*key, F.col(name).alias("_v")), list(key), "left")
    if not dense:
        return joined.withColumnRenamed("_v", name)
    pages = values.select(F.floor(F.col(key[-1]) / page).alias("_page")).distinct().withColumn("_has", F.lit(True))
    joined = joined.withColumn("_page", F.floor(F.col(key[-1]) / page)).join(pages, "_page", "left")
    return joined.withColumn(name, F.coalesce("_v", F.when(F.col("_has"), F.lit(0)))).drop("_v", "_page", "_has")
