"""Bit patterns: half floats, Morton codes, zigzag, packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_to_double(bits: Column) -> Column:
    """Value of a half-precision bit pattern; subnormals, infinities and NaN are exact."""
    b = bits.cast("int")
    sign = F.when(b.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    power = F.shiftright(b, 10).bitwiseAND(31)
    part = b.bitwiseAND(1023).cast("double")
    return (
        F.when(power == 0, sign * part * 2.0**-24)
        .when((power == 31) & (part == 0), sign * float("inf"))
        .when(power == 31, F.lit(float("nan")))
        .otherwise(sign * (1024 + part) * F.pow(F.lit(2.0), power - 25))
    )


def double_to_half(x: Column) -> Column:
    """Half-precision bit pattern, ties away from zero; NaN becomes infinity, as overflow does."""
    a = F.abs(x)
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), 0x8000).otherwise(0)
    safe = F.when((a > 0) & (a < 65536.0), a).otherwise(1.0)
    power = F.floor(F.log2(safe)).cast("int")
    power = power + F.when(F.pow(F.lit(2.0), power + 1) <= safe, 1).when(F.pow(F.lit(2.0), power) > safe, -1).otherwise(0)
    normal = F.floor(safe / F.pow(F.lit(2.0), power - 10) + 0.5).cast("int") - 1024 + F.shiftleft(power + 15, 10)
    tiny = F.floor(safe * 2.0**24 + 0.5).cast("int")
    value = F.when(a == 0, 0).when(F.isnan(x) | (a >= 65520.0), 0x7C00).when(a < 2.0**-14, tiny).otherwise(normal)
    return (value + sign).cast("int")


def ordered_half(bits: Column) -> Column:
    """Order-preserving code of a half bit pattern: negatives are inverted, positives lifted."""
    return F.when(bits.bitwiseAND(0x8000) != 0, 0xFFFF - bits).otherwise(bits + 0x8000).cast("int")


def half_from_ordered(code: Column) -> Column:
    return F.when(code >= 0x8000, code - 0x8000).otherwise(0xFFFF - code).cast("int")


def wrap16(delta: Column) -> Column:
    """A difference modulo 2**16 as a signed 16-bit number."""
    return ((delta + 32768).bitwiseAND(0xFFFF) - 32768).cast("int")


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2 ... as 0, 1, 2, 3 ..."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 0, F.floor(u / 2)).otherwise(-F.floor((u + 1) / 2)).cast("long")


def varint_size(u: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    out = F.lit(1)
    for k in range(1, 9):
        out = out + F.when(u >= (1 << (7 * k)), 1).otherwise(0)
    return out


def spread10(v: Column) -> Column:
    """Ten bits, two zeros after each."""
    v = v.cast("long").bitwiseAND(1023)
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def gather10(v: Column) -> Column:
    """The inverse of :func:`spread10`."""
    v = v.cast("long").bitwiseAND(F.lit(0x09249249).cast("long"))
    for shift, mask in ((2, 0x030C30C3), (4, 0x0300F00F), (8, 0x030000FF), (16, 0x3FF)):
        v = v.bitwiseXOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def cell10(x: Column, centre: float, half: float) -> Column:
    """Grid coordinate 0..1023 of ``x`` in a cube of half-width ``half``."""
    return F.greatest(F.lit(0), F.least(F.lit(1023), F.floor((x - (centre - half)) * 1023 / (2 * half) + 0.5))).cast("long")


def morton(x: Column, y: Column, z: Column) -> Column:
    """30-bit code that interleaves three ten-bit coordinates, x lowest."""
    return spread10(x).bitwiseOR(F.shiftleft(spread10(y), 1)).bitwiseOR(F.shiftleft(spread10(z), 2))


def morton_inverse(code: Column) -> tuple[Column, Column, Column]:
    return gather10(code), gather10(F.shiftright(code, 1)), gather10(F.shiftright(code, 2))


def pack_xyz(x: Column, y: Column, z: Column, bits: tuple[int, int, int] = (11, 10, 11)) -> Column:
    """Three unsigned codes in one long, x in the lowest bits."""
    return x.cast("long").bitwiseOR(F.shiftleft(y.cast("long"), bits[0])).bitwiseOR(F.shiftleft(z.cast("long"), bits[0] + bits[1]))


def unpack_xyz(packed: Column, bits: tuple[int, int, int] = (11, 10, 11)) -> tuple[Column, Column, Column]:
    part = lambda shift, n: F.shiftright(packed, shift).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    return part(0, bits[0]), part(bits[0], bits[1]), part(bits[0] + bits[1], bits[2])
