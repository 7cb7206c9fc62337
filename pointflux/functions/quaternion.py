"""Quaternions as struct columns (w, x, y, z)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("w", "x", "y", "z")
EPS = 1e-12


def quat(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((w, x, y, z), AXES, strict=True)])


IDENTITY = (1.0, 0.0, 0.0, 0.0)


def identity() -> Column:
    return quat(*[F.lit(v) for v in IDENTITY])


def dot(a: Column, b: Column) -> Column:
    return sum((a[n] * b[n] for n in AXES[1:]), a["w"] * b["w"])


def scale(q: Column, s: Column) -> Column:
    return quat(*[q[n] * s for n in AXES])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(q: Column) -> Column:
    """Unit quaternion; one shorter than 1e-12 or not finite becomes the identity."""

    def unit(s: Column) -> Column:
        good = (s["n"] > EPS) & (s["n"] < float("inf")) & ~F.isnan(s["n"])
        return F.when(good, scale(s["q"], 1.0 / F.when(good, s["n"]).otherwise(1.0))).otherwise(identity())

    return let(q, lambda v: let(F.struct(v.alias("q"), F.sqrt(dot(v, v)).alias("n")), unit))


def conjugate(q: Column) -> Column:
    return quat(q["w"], -q["x"], -q["y"], -q["z"])


def multiply(a: Column, b: Column) -> Column:
    return quat(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def rotate(q: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A vector turned by a unit quaternion."""
    tx, ty, tz = 2 * (q["y"] * z - q["z"] * y), 2 * (q["z"] * x - q["x"] * z), 2 * (q["x"] * y - q["y"] * x)
    return (
        x + q["w"] * tx + q["y"] * tz - q["z"] * ty,
        y + q["w"] * ty + q["z"] * tx - q["x"] * tz,
        z + q["w"] * tz + q["x"] * ty - q["y"] * tx,
    )


def angle_degrees(a: Column, b: Column) -> Column:
    """Rotation between two unit quaternions; q and -q are the same rotation."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)))) * (180.0 / math.pi)


def _blend(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    return quat(*[a[n] * fa + b[n] * fb for n in AXES])


def _slerp(ends: Column, alpha: Column, straight: Callable[[Column, Column], Column]) -> Column:
    """Blend the unit quaternions ``ends.l`` and ``ends.r`` over the shorter arc."""

    def blended(s: Column) -> Column:
        near = straight(s["d"], s["s"])
        safe = F.when(near, 1.0).otherwise(s["s"])
        fa = F.when(near, 1 - alpha).otherwise(F.sin((1 - alpha) * s["t"]) / safe)
        fb = F.when(near, alpha).otherwise(F.sin(alpha * s["t"]) / safe)
        return let(F.struct(fa.alias("a"), (fb * s["sign"]).alias("b")), lambda f: _blend(s["l"], s["r"], f["a"], f["b"]))

    def angled(s: Column) -> Column:
        sign = F.when(s["d0"] < 0, -1.0).otherwise(1.0)
        d = F.least(F.lit(1.0), F.abs(s["d0"]))
        return F.struct(s["l"].alias("l"), s["r"].alias("r"), sign.alias("sign"), d.alias("d"), F.acos(d).alias("t"), F.sin(F.acos(d)).alias("s"))

    with_dot = let(ends, lambda e: F.struct(e["l"].alias("l"), e["r"].alias("r"), dot(e["l"], e["r"]).alias("d0")))
    return normalize(let(let(with_dot, angled), blended))


def slerp(left: Column, right: Column, alpha: Column) -> Column:
    """Shortest-arc interpolation for playback: ends are normalized, a zero quaternion is the
    identity, and arcs with a sine up to 1e-5 are blended straight."""
    return _slerp(F.struct(normalize(left).alias("l"), normalize(right).alias("r")), alpha, lambda d, s: s <= 1e-5)


def slerp_export(left: Column, right: Column, alpha: Column) -> Column:
    """Shortest-arc interpolation for exports: a zero right end repeats the left one, and dots
    over 0.9995 are blended straight. Differs from :func:`slerp` on purpose."""
    ends = let(
        F.struct(normalize(left).alias("l"), right.alias("r")),
        lambda e: F.struct(e["l"].alias("l"), F.when(dot(e["r"], e["r"]) <= EPS * EPS, e["l"]).otherwise(normalize(e["r"])).alias("r")),
    )
    return _slerp(ends, alpha, lambda d, s: d > 0.9995)


def from_euler(rx: Column, ry: Column, rz: Column) -> Column:
    """Rotation about x, then y, then z, in radians."""
    c = [F.cos(a / 2) for a in (rx, ry, rz)]
    s = [F.sin(a / 2) for a in (rx, ry, rz)]
    return quat(
        c[0] * c[1] * c[2] + s[0] * s[1] * s[2],
        s[0] * c[1] * c[2] - c[0] * s[1] * s[2],
        c[0] * s[1] * c[2] + s[0] * c[1] * s[2],
        c[0] * c[1] * s[2] - s[0] * s[1] * c[2],
    )


def log(q: Column) -> Column:
    """Rotation vector (x, y, z) of a unit quaternion, taking the shorter turn."""
    q = F.when(q["w"] < 0, scale(q, F.lit(-1.0))).otherwise(q)
    v = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    f = F.when(v > EPS, 2 * F.atan2(v, q["w"]) / F.when(v > EPS, v).otherwise(1.0)).otherwise(2.0)
    return F.struct(*[(q[n] * f).alias(n) for n in AXES[1:]])


def exp(v: Column) -> Column:
    """Unit quaternion of a rotation vector."""
    a = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    f = F.when(a > EPS, F.sin(a / 2) / F.when(a > EPS, a).otherwise(1.0)).otherwise(0.5)
    return quat(F.cos(a / 2), *[v[n] * f for n in AXES[1:]])


def smallest_three(q: Column, bits: int = 12) -> Column:
    """A unit quaternion as (index of its largest component, three codes of ``bits`` bits).

    Of equal largest magnitudes the first counts; the sign is fixed so that it is positive.
    """
    parts = F.array(*[q[n] for n in AXES])
    mags = F.transform(parts, F.abs)
    at = (F.array_position(mags, F.array_max(mags)) - 1).cast("int")
    sign = F.when(F.get(parts, at) < 0, -1.0).otherwise(1.0)
    top, half = float((1 << bits) - 1), math.sqrt(0.5)
    codes = F.transform(
        F.filter(F.transform(parts, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: s["i"] != at),
        lambda s: F.greatest(F.lit(0.0), F.least(F.lit(top), F.floor((s["v"] * sign + half) / (2 * half) * top + 0.5))).cast("int"),
    )
    return F.struct(at.alias("largest"), codes.alias("codes"))


def from_smallest_three(code: Column, bits: int = 12) -> Column:
    top, half = float((1 << bits) - 1), math.sqrt(0.5)
    three = F.transform(code["codes"], lambda c: c / top * (2 * half) - half)
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - F.aggregate(three, F.lit(0.0), lambda a, v: a + v * v)))
    part = lambda i: F.when(code["largest"] == i, rest).otherwise(F.get(three, F.when(code["largest"] < i, F.lit(i - 1)).otherwise(F.lit(i))))
    return quat(*[part(i) for i in range(4)])
