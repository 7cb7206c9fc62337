"""Byte streams: planes, chunks, digests, compression, entropy coding."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

CHUNK = 16 << 20


def planes(raw: bytes) -> bytes:
    """Low bytes, then high bytes; an odd length is padded with a zero."""
    a = np.frombuffer(raw + b"\0" * (len(raw) % 2), np.uint8).reshape(-1, 2)
    return a.T.tobytes()


def unplanes(data: bytes, size: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(2, -1).T.tobytes()[:size]


@F.pandas_udf(BinaryType())
def _shuffle(raw: pd.Series) -> pd.Series:
    return raw.map(planes, na_action="ignore")


@F.pandas_udf(BinaryType())
def _unshuffle(data: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else unplanes(d, int(n)) for d, n in zip(data, size, strict=True)])


def shuffle16(raw: str | Column) -> Column:
    return _shuffle(raw)


def unshuffle16(data: str | Column, size: str | Column) -> Column:
    return _unshuffle(data, size)


def bundle(files: DataFrame, name: str = "name", data: str = "data", chunk: int = CHUNK) -> DataFrame:
    """Lossless chunks ``(name, chunk, raw_size, raw_sha, stored, stored_sha)`` of binary files.

    Chunks are cut in the JVM; each is plane-shuffled and deflated on its own, so
    any of them is read back alone.
    """
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(data) / chunk).cast("int") - 1, F.lit(0))))
    parts = files.select(name, data, cut.alias("chunk")).select(name, "chunk", F.substr(data, F.col("chunk") * chunk + 1, F.lit(chunk)).alias("raw"))

    @F.pandas_udf(BinaryType())
    def pack(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: zlib.compress(planes(b), 6))

    stored = parts.select(name, "chunk", F.octet_length("raw").alias("raw_size"), F.sha2("raw", 256).alias("raw_sha"), pack("raw").alias("stored"))
    return stored.withColumn("stored_sha", F.sha2("stored", 256))


def unbundle(chunks: DataFrame, name: str = "name") -> DataFrame:
    """Files again ``(name, data)``; a chunk that fails either digest fails the read."""

    @F.pandas_udf(BinaryType())
    def unpack(stored: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([unplanes(zlib.decompress(b), int(n)) for b, n in zip(stored, size, strict=True)])

    whole = F.when(F.sha2("stored", 256) == F.col("stored_sha"), F.col("stored")).otherwise(F.raise_error(F.lit("a stored chunk is damaged")).cast("binary"))
    rows = chunks.select(name, "chunk", "raw_sha", unpack(whole, "raw_size").alias("raw"))
    sound = F.when(F.sha2("raw", 256) == F.col("raw_sha"), F.col("raw")).otherwise(F.raise_error(F.lit("a chunk differs from what was stored")).cast("binary"))
    lists = rows.select(name, "chunk", sound.alias("raw")).groupBy(name).agg(F.sort_array(F.collect_list(F.struct("chunk", "raw"))).alias("p"))
    return lists.select(name, F.aggregate(F.col("p.raw"), F.lit(b""), lambda a, b: F.concat(a, b)).alias("data"))


def normalized_frequencies(counts: Sequence[int], bits: int = 12) -> list[int]:
    """Frequencies that sum to 2**bits by largest remainders; a symbol in use gets one at least."""
    c, top = np.asarray(counts, np.int64), 1 << bits
    total = int(c.sum())
    if not total:
        return [0] * len(c)
    exact = c * top / total
    f = np.where(c > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    order = sorted(range(len(c)), key=lambda i: (-(exact[i] - np.floor(exact[i])), i))
    while f.sum() < top:
        for i in order:
            if c[i] and f.sum() < top:
                f[i] += 1
    while f.sum() > top:
        f[int(np.argmax(f))] -= 1
    return f.tolist()


def rans_encode(data: bytes, freqs: Sequence[int], bits: int = 12) -> bytes:
    """Static range coding of bytes: a 32-bit state, flushed byte by byte."""
    start = np.concatenate([[0], np.cumsum(freqs)]).tolist()
    low, state, out = 1 << 23, 1 << 23, bytearray()
    for s in reversed(data):
        limit = ((low >> bits) << 8) * freqs[s]
        while state >= limit:
            out.append(state & 255)
            state >>= 8
        state = ((state // freqs[s]) << bits) + state % freqs[s] + start[s]
    return state.to_bytes(4, "little") + bytes(reversed(out))


def rans_decode(code: bytes, freqs: Sequence[int], n: int, bits: int = 12) -> bytes:
    start = np.concatenate([[0], np.cumsum(freqs)])
    symbol = np.repeat(np.arange(len(freqs)), freqs)
    state, at, out, mask = int.from_bytes(code[:4], "little"), 4, bytearray(), (1 << bits) - 1
    for _ in range(n):
        slot = state & mask
        s = int(symbol[slot])
        out.append(s)
        state = freqs[s] * (state >> bits) + slot - int(start[s])
        while state < 1 << 23 and at < len(code):
            state = (state << 8) | code[at]
            at += 1
    return bytes(out)


def golomb_bits(value: int, divisor: int) -> int:
    """Bits of a truncated-binary Golomb code."""
    q, rest = divmod(value, divisor)
    b = max(1, (divisor - 1).bit_length())
    short = (1 << b) - divisor
    return q + 1 + (0 if divisor == 1 else b - 1 if rest < short else b)


def golomb_cost(values: DataFrame, value: str, divisors: Sequence[int]) -> DataFrame:
    """Total bits of each candidate divisor: ``(divisor, bits)``, one aggregate for all of them."""

    def cost(m: int) -> Column:
        b = max(1, (m - 1).bit_length())
        short = (1 << b) - m
        rest = F.col(value) % m
        tail = F.lit(0) if m == 1 else F.when(rest < short, b - 1).otherwise(b)
        return F.sum(F.floor(F.col(value) / m) + 1 + tail)

    one = values.agg(*[cost(m).cast("long").alias(f"m{m}") for m in divisors])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("divisor"), F.col(f"m{m}").alias("bits")) for m in divisors])).alias("c")).select("c.*")
