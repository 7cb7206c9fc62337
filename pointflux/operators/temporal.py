"""Encodings along a track: chains, residuals, change streams, knots, simplification.

Open-loop encodings are windows over a track's keys. Closed loops, where a code
depends on what was decoded before it, run track by track in Arrow batches; a
track has a bounded number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import numeric as N
from ..functions import quaternion as Q


def _track(track: str, k: str) -> Window:
    return Window.partitionBy(track).orderBy(k)


def xor_chain(rows: DataFrame, value: str, track: str = "track", k: str = "k") -> DataFrame:
    """``code``: each value xor the one before it in its track; the first stays."""
    return rows.withColumn("code", F.col(value).bitwiseXOR(F.coalesce(F.lag(value).over(_track(track, k)), F.lit(0))))


def xor_unchain(rows: DataFrame, code: str = "code", track: str = "track", k: str = "k") -> DataFrame:
    """The inverse of :func:`xor_chain`: a running xor over each track's codes."""
    return rows.withColumn("decoded", F.bit_xor(code).over(_track(track, k).rowsBetween(Window.unboundedPreceding, 0)))


def delta16(rows: DataFrame, value: str, track: str = "track", k: str = "k") -> DataFrame:
    """``delta``, signed modulo 2**16, and its ``zigzag``; the first key's delta is its value."""
    d = B.wrap16(F.col(value) - F.coalesce(F.lag(value).over(_track(track, k)), F.lit(0)))
    return rows.withColumn("delta", d).withColumn("zigzag", B.zigzag(F.col("delta")))


def undelta16(rows: DataFrame, delta: str = "delta", track: str = "track", k: str = "k") -> DataFrame:
    total = F.sum(delta).over(_track(track, k).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("decoded", total.bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int"))


def residuals(rows: DataFrame, value: str, track: str = "track", k: str = "k") -> DataFrame:
    """``kind`` and ``residual``: the first key whole, the last against the first, inner ones against their line.

    A line's value is rounded half up before it is subtracted.
    """
    whole = Window.partitionBy(track).orderBy(k).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a, b = F.first(value).over(whole), F.last(value).over(whole)
    ka, kb = F.first(k).over(whole), F.last(k).over(whole)
    alpha = N.span_alpha(F.col(k), ka, kb)
    kind = F.when(F.col(k) == ka, "birth").when(F.col(k) == kb, "endpoint").otherwise("internal")
    line = N.js_round(N.lerp(a.cast("double"), b.cast("double"), alpha)).cast("long")
    res = F.when(kind == "birth", F.col(value)).when(kind == "endpoint", F.col(value) - a).otherwise(F.col(value) - line)
    return rows.withColumns({"kind": kind, "residual": res.cast("long")})


def lifting(rows: DataFrame, value: str, cell: Column, track: str = "track", k: str = "k") -> DataFrame:
    """Deltas less their global mean and then their cell's mean, both rounded: ``(..., delta, residual)``.

    The global mean is one row and broadcast; cells are joined by an equal key.
    """
    d = F.col(value) - F.lag(value).over(_track(track, k))
    moves = rows.withColumns({"delta": d, "cell": cell}).where("delta is not null")
    mean = moves.agg(N.js_round(F.avg("delta")).alias("_g"))
    means = moves.crossJoin(F.broadcast(mean)).groupBy("cell").agg(F.first("_g").alias("_g"), N.js_round(F.avg(F.col("delta") - F.col("_g"))).alias("_c"))
    return moves.join(means, "cell").withColumn("residual", (F.col("delta") - F.col("_g") - F.col("_c")).cast("long")).drop("_g", "_c")


def keep_first(rows: DataFrame, value: str, track: str = "track", k: str = "k") -> DataFrame:
    """``residual`` of each key against its track's first."""
    return rows.withColumn("residual", F.col(value) - F.first(value).over(_track(track, k).rowsBetween(Window.unboundedPreceding, 0)))


def rq_transform(rows: DataFrame, value: str, track: str = "track", k: str = "k") -> DataFrame:
    """Base against the previous track's last, inner keys against the line, last against base, where tracks follow one another by ``segment``."""
    whole = Window.partitionBy(track, "segment").orderBy(k).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = rows.groupBy(track, "segment").agg(F.min_by(value, k).alias("_a"), F.max_by(value, k).alias("_b"), F.min(k).alias("_ka"), F.max(k).alias("_kb"))
    ends = ends.withColumn("_p", F.coalesce(F.lag("_b").over(Window.partitionBy(track).orderBy("segment")), F.lit(0)))
    j = rows.join(ends, [track, "segment"])
    line = N.lerp(F.col("_a").cast("double"), F.col("_b").cast("double"), N.span_alpha(F.col(k), F.col("_ka"), F.col("_kb")))
    out = F.when(F.col(k) == F.col("_ka"), F.col(value) - F.col("_p")).when(F.col(k) == F.col("_kb"), F.col(value) - F.col("_a")).otherwise(F.col(value) - line)
    return j.withColumn("residual", out).drop("_a", "_b", "_ka", "_kb", "_p")


def changes(rows: DataFrame, value: str, track: str = "track", k: str = "k") -> DataFrame:
    """``first`` and ``changed``: whether a key opens its track or differs from the key before."""
    prev = F.lag(F.struct(F.col(value))).over(_track(track, k))
    return rows.withColumns({"first": prev.isNull(), "changed": prev.isNull() | ~prev[value].eqNullSafe(F.col(value))})


def _per_track(rows: DataFrame, track: str, k: str, values: Sequence[str], fn: Callable[[np.ndarray, list[np.ndarray]], dict[str, list]], schema: str) -> DataFrame:
    """``fn(keys, columns)`` of each track, sorted by key; many tracks share an Arrow batch.

    Tracks become arrays first, combined before the shuffle, so the Python side
    has a row for each track and not a call for each group.
    """
    entry = F.struct(k, *[F.col(v).cast("double").alias(v) for v in values])
    tracks = rows.groupBy(track).agg(F.sort_array(F.collect_list(entry)).alias("keys"))
    tracks = tracks.select(track, F.col(f"keys.{k}").alias(k), *[F.col(f"keys.{v}").alias(v) for v in values])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {}
            for row in zip(pdf[track], pdf[k], *[pdf[v] for v in values], strict=True):
                part = fn(np.asarray(row[1]), [np.asarray(v, float) for v in row[2:]])
                n = len(next(iter(part.values())))
                out.setdefault(track, []).extend([row[0]] * n)
                for name, column in part.items():
                    out.setdefault(name, []).extend(column)
            if out:
                yield pd.DataFrame(out)

    return tracks.mapInPandas(run, schema)


def thresholded_updates(rows: DataFrame, value: str, limit: float, track: str = "track", k: str = "k") -> DataFrame:
    """Keys that differ by more than ``limit`` from the last one *emitted*; the first is always emitted."""

    def run(ks: np.ndarray, columns: list[np.ndarray]) -> dict[str, list]:
        last, keep = None, []
        for i, v in enumerate(columns[0]):
            if last is None or abs(v - last) > limit:
                keep.append(i)
                last = v
        return {k: ks[keep].tolist(), value: columns[0][keep].tolist()}

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return _per_track(rows, track, k, [value], run, f"{track} {kinds[track]}, {k} {kinds[k]}, {value} double")


def closed_loop(rows: DataFrame, value: str, step: float, track: str = "track", k: str = "k") -> DataFrame:
    """Quantized differences to the *decoded* previous key: ``(track, k, code, decoded)``; errors don't add up."""

    def run(ks: np.ndarray, columns: list[np.ndarray]) -> dict[str, list]:
        at, codes, decoded = 0.0, [], []
        for v in columns[0]:
            c = int(np.floor((v - at) / step + 0.5))
            at += c * step
            codes.append(c)
            decoded.append(at)
        return {k: ks.tolist(), "code": codes, "decoded": decoded}

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return _per_track(rows, track, k, [value], run, f"{track} {kinds[track]}, {k} {kinds[k]}, code long, decoded double")


def so3_chain(rows: DataFrame, step_degrees: float = 0.1, track: str = "track", k: str = "k") -> DataFrame:
    """Closed-loop rotation chain over columns qw..qz: the tangent from the decoded previous
    rotation in steps of ``step_degrees`` / 2: ``(track, k, cx, cy, cz, error_degrees)``."""
    step = np.radians(step_degrees) / 2

    def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        w, v = a[0], a[1:]
        return np.concatenate([[w * b[0] - v @ b[1:]], w * b[1:] + b[0] * v + np.cross(v, b[1:])])

    def log(q: np.ndarray) -> np.ndarray:
        q = -q if q[0] < 0 else q
        n = np.linalg.norm(q[1:])
        return q[1:] * (2 * np.arctan2(n, q[0]) / n if n > 1e-12 else 2.0)

    def exp(v: np.ndarray) -> np.ndarray:
        a = np.linalg.norm(v)
        return np.concatenate([[np.cos(a / 2)], v * (np.sin(a / 2) / a if a > 1e-12 else 0.5)])

    def run(ks: np.ndarray, columns: list[np.ndarray]) -> dict[str, list]:
        at, out = np.array([1.0, 0, 0, 0]), []
        for q in np.stack(columns, 1):
            n = np.linalg.norm(q)
            q = q / n if n > 1e-12 else np.array([1.0, 0, 0, 0])
            code = np.rint(log(mul(at * [1, -1, -1, -1], q)) / step)
            at = mul(at, exp(code * step))
            at /= np.linalg.norm(at)
            out.append((*code.astype(int), float(np.degrees(2 * np.arccos(min(1.0, abs(at @ q)))))))
        return {k: ks.tolist()} | dict(zip(("cx", "cy", "cz", "error_degrees"), map(list, zip(*out)), strict=True))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return _per_track(rows, track, k, ["qw", "qx", "qy", "qz"], run, f"{track} {kinds[track]}, {k} {kinds[k]}, cx long, cy long, cz long, error_degrees double")


def rice_modes(rows: DataFrame, value: str, block: str, k: str, ks: int = 21) -> DataFrame:
    """The cheapest predictor and Rice parameter of each block: ``(block, mode, rice, bits)``.

    Modes are raw, first difference, second difference and difference to the block's
    first value; ties go to the earlier mode and the smaller parameter.
    """
    w = Window.partitionBy(block).orderBy(k)
    p1, p2 = F.lag(value, 1, 0).over(w), F.lag(value, 2, 0).over(w)
    modes = {"0 raw": F.col(value), "1 first": F.col(value) - p1, "2 second": F.col(value) - 2 * p1 + p2, "3 anchor": F.col(value) - F.when(F.row_number().over(w) == 1, 0).otherwise(F.first(value).over(w))}
    rows = rows.select(block, *[B.zigzag(c.cast("long")).alias(n) for n, c in modes.items()])
    sums = [F.sum(F.shiftright(F.col(f"`{n}`"), j) + 1 + j).alias(f"{n}|{j}") for n in modes for j in range(ks)]
    each = rows.groupBy(block).agg(*sums)
    best = F.array_min(F.array(*[F.struct(F.col(f"`{n}|{j}`").cast("long").alias("bits"), F.lit(n).alias("mode"), F.lit(j).alias("rice")) for n in modes for j in range(ks)]))
    return each.select(block, best.alias("b")).select(block, "b.mode", "b.rice", "b.bits")


def _far(t: np.ndarray, v: np.ndarray, i: int, j: int) -> float:
    """The largest distance of the keys between i and j from the line through those.

    Multiplied before it is divided, as in SQL: so a whole difference is rounded
    once, and a distance of exactly a limit is not moved past it by a rounded share.
    """
    if j <= i + 1:
        return 0.0
    mid = slice(i + 1, j)
    off = v[i] + (v[j] - v[i]) * (t[mid] - t[i])[:, None] / (t[j] - t[i]) - v[mid]
    return float(np.linalg.norm(off, axis=1).max())


def fewest_knots(t: np.ndarray, v: np.ndarray, limit: float, hard: float | None = None) -> list[int]:
    """The fewest keys, ends included, whose lines stay within ``limit`` of every key in between.

    ``v`` has a row for each key. A track that stays within ``limit`` of its first
    key keeps that one; one that its knots miss by more than ``hard`` keeps all.
    """
    v = v.reshape(len(t), -1)
    n = len(t)
    if n and np.linalg.norm(v - v[0], axis=1).max() <= limit:
        return [0]
    best, prev = [0] + [n + 1] * (n - 1), [-1] * n
    for j in range(1, n):
        for i in range(j):
            if best[i] + 1 < best[j] and _far(t, v, i, j) <= limit:
                best[j], prev[j] = best[i] + 1, i
    out = [n - 1]
    while out[-1] > 0:
        out.append(prev[out[-1]])
    out = out[::-1]
    if hard is not None and max(_far(t, v, i, j) for i, j in zip(out, out[1:])) > hard:
        return list(range(n))
    return out


def simplify(t: np.ndarray, v: np.ndarray, limit: float) -> list[int]:
    """Keys kept by recursive splitting at the first largest error, up to 1e-12 of rounding; a constant track keeps one."""
    if len(v) == 0 or np.abs(v - v[0]).max() <= limit and len(v) > 1:
        return [0][: len(v)]
    keep, todo = {0, len(v) - 1}, [(0, len(v) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            mid = np.arange(a + 1, b)
            err = np.abs(v[a] + (v[b] - v[a]) * (t[mid] - t[a]) / (t[b] - t[a]) - v[mid])
            split = (err > limit) & (err >= err.max() - 1e-12)
            if split.any():
                m = int(mid[split.argmax()])
                keep.add(m)
                todo += [(a, m), (m, b)]
    return sorted(keep)


def knots(rows: DataFrame, value: str | Sequence[str], limit: float, method: str = "fewest", track: str = "track", frame: str = "frame", hard: float | None = None) -> DataFrame:
    """``(track, n_keys, n_kept, max_error)`` of each track after keeping only its knots; several values are one point."""
    values = [value] if isinstance(value, str) else list(value)

    def run(ks: np.ndarray, columns: list[np.ndarray]) -> dict[str, list]:
        t, v = ks.astype(float), np.stack(columns, 1)
        at = fewest_knots(t, v, limit, hard) if method == "fewest" else simplify(t, v[:, 0], limit)
        rebuilt = np.stack([np.interp(t, t[at], c[at]) for c in v.T], 1)
        return {"n_keys": [len(t)], "n_kept": [len(at)], "max_error": [float(np.linalg.norm(rebuilt - v, axis=1).max())]}

    if method not in ("fewest", "simplify"):
        raise ValueError(f"unknown method {method}")
    kind = rows.schema[track].dataType.simpleString()
    return _per_track(rows, track, frame, values, run, f"{track} {kind}, n_keys int, n_kept int, max_error double")


def cube_turns() -> list[tuple[float, float, float, float]]:
    """The 24 rotations that map a cube onto itself, as unit quaternions with a first positive component."""
    half = 0.5**0.5
    found = [(1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0)]
    for i in range(4):
        for j in range(i + 1, 4):
            for s in (half, -half):
                q = [0.0] * 4
                q[i], q[j] = half, s
                found.append(tuple(q))
    return found + [(0.5, a, b, c) for a in (0.5, -0.5) for b in (0.5, -0.5) for c in (0.5, -0.5)]


def continuous_symmetry(rows: DataFrame, track: str = "track", k: str = "k") -> DataFrame:
    """``(track, k, symmetry, closeness)`` of rotations qw..qz: which of a cube's 24 turns brings each closest to its track's first.

    An ellipsoid's axes can be named in 24 ways with the same shape; the way whose
    quaternion is closest (largest absolute product, the first of equals within
    1e-9) keeps a track's attributes continuous. The first key's own symmetry is 0.
    """
    q = ("qw", "qx", "qy", "qz")
    first = F.first(F.struct(*q)).over(_track(track, k))
    own = Q.quat(*[F.col(c) for c in q])
    rows = rows.withColumn("_first", first)

    def closeness(turn: tuple[float, ...]) -> Column:
        turned = Q.multiply(own, Q.quat(*[F.lit(c) for c in turn]))
        return F.abs(Q.dot(turned, Q.quat(*[F.col(f"_first.{c}") for c in q])))

    each = F.array(*[closeness(t) for t in cube_turns()])
    rows = rows.withColumn("_each", each).withColumn("closeness", F.array_max("_each"))
    near = F.transform("_each", lambda x: x >= F.col("closeness") - 1e-9)
    return rows.select(track, k, (F.array_position(near, True) - 1).cast("int").alias("symmetry"), "closeness")
