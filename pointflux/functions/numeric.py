"""Scalars: sigmoids, interpolation, clamps, quantization, signed logs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities are kept this far from 0 and 1 before a logit.
ALPHA_EPS = 1e-6
#: Fixed value: steepness of the lifetime gate.
GATE_K = 10.0
NEG_INF = float("-inf")


def finite(x: Column) -> Column:
    """Whether ``x`` is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """ln(sigmoid(x)) without overflow on either side."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def logit(alpha: Column) -> Column:
    """Logit of a clamped probability; NaN and infinities give 0."""
    a = F.greatest(F.lit(ALPHA_EPS), F.least(F.lit(1 - ALPHA_EPS), alpha))
    return F.when(finite(alpha), F.ln(a / (1 - a))).otherwise(0.0)


def lerp(left: Column, right: Column, alpha: Column) -> Column:
    return left + (right - left) * alpha


def extended_lerp(left: Column, right: Column, alpha: Column) -> Column:
    """Interpolation in which minus infinity means "absent" and wins strictly between two keys."""
    absent = (left == NEG_INF) | (right == NEG_INF)
    return F.when((alpha <= 0) | (left == right), left).when(alpha >= 1, right).when(absent, F.lit(NEG_INF)).otherwise(lerp(left, right, alpha))


def span_alpha(at: Column, left: Column, right: Column) -> Column:
    """Position of ``at`` between two keys, clamped to 0..1; equal keys give 0."""
    return F.when(right == left, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - left) / F.nullif(right - left, F.lit(0.0)))))


def endpoint_alpha(at: Column, mu: Column, width: Column) -> Column:
    """Position of ``at`` within a point's own lifetime [mu - width, mu + width]; a degenerate one gives 0."""
    return F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - (mu - width)) / F.nullif(2 * width, F.lit(0.0))))).otherwise(0.0)


def lifetime_gate(at: Column, mu: Column, width: Column) -> Column:
    """Soft gate of a lifetime mu +- width: a product of two sigmoids, not an interval."""
    return sigmoid(GATE_K * (at - (mu - width))) * sigmoid(GATE_K * ((mu + width) - at))


def js_round(x: Column) -> Column:
    """Round half up, towards plus infinity."""
    return F.floor(x + 0.5)


def signed_expm1(x: Column) -> Column:
    """The inverse of a signed logarithm: sign(x) * (exp(|x|) - 1)."""
    return F.signum(x) * F.expm1(F.abs(x))


def quantize(x: Column, low: float, high: float, bits: int) -> Column:
    """Linear code of ``x`` in ``bits`` bits over [low, high], half to even, clamped."""
    top = float((1 << bits) - 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(top), F.rint((x - low) / (high - low) * top))).cast("long")


def dequantize(code: Column, low: float, high: float, bits: int) -> Column:
    return F.lit(low) + code.cast("double") / float((1 << bits) - 1) * (high - low)


def quantize_opacity(logits: Column, low: float, high: float, bits: int = 16) -> Column:
    """As :func:`quantize`, with code 0 kept for minus infinity and 1..2**bits-1 for finite values."""
    top = float((1 << bits) - 2)
    code = 1 + F.greatest(F.lit(0.0), F.least(F.lit(top), F.rint((logits - low) / (high - low) * top)))
    return F.when(logits == NEG_INF, F.lit(0)).otherwise(code).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def format_bytes(n: Column) -> Column:
    """Decimal units with one digit, ties rounded up, bytes without; the unit is chosen before rounding. Null gives null."""
    n = n.cast("long")
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    out = F.when(n.isNotNull(), F.format_string("%d B", n))
    for size, unit in ((10**3, "kB"), (10**6, "MB"), (10**9, "GB")):
        tenths = div(n % size * 10 + size // 2, size)  # of the rest; 10 carry over
        out = F.when(n >= size, F.format_string(f"%d.%d {unit}", div(n, size) + div(tenths, 10), tenths % 10)).otherwise(out)
    return out


def ycocg_forward(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Lossless integer lifting of a colour: (y, co, cg)."""
    co = r - b
    t = b + F.shiftright(co, 1)
    cg = g - t
    return t + F.shiftright(cg, 1), co, cg


def ycocg_inverse(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    t = y - F.shiftright(cg, 1)
    g = cg + t
    b = t - F.shiftright(co, 1)
    return b + co, g, b


def gray(r: Column, g: Column, b: Column) -> Column:
    """Integer luma of 8-bit channels."""
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


#: Fixed value: the zeroth spherical harmonic.
SH_C0 = 0.28209479177387814


def dc_to_rgb(dc: Column) -> Column:
    return 0.5 + SH_C0 * dc


def degrees(x: Column) -> Column:
    return x * (180.0 / math.pi)
