"""Best-fit packing of documents into bins of several permitted lengths.

Items go longest first into the open bin that they fill best. Where none has
room, a bin opens with the length that is expected to cost least for each token
it will hold: every length is filled on trial, largest first, from the sizes
still to be placed, and shrunk to that content. At the end each bin shrinks to
the smallest permitted length that holds its contents. As bins opened early
take small items that others would need, whole packings are compared as well:
with all lengths to open and with each one beside the longest; the cheapest stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, word_count

LENGTHS = (512, 1024, 2048, 4096)
#: Tokens that starting any bin costs, and the cost of a token for each token of its bin's length.
START_COST, ATTENTION = 64.0, 1 / 65_536
#: Pieces packed together, about; bins don't span groups.
GROUP_ROWS = 20_000


def cost(length: int) -> float:
    return START_COST + length * (1 + ATTENTION * length)


class _Stock:
    """How many pieces of each size are still to be placed; a bit for each size in stock finds the largest that fits."""

    def __init__(self, sizes: np.ndarray, longest: int) -> None:
        self.count = np.bincount(sizes, minlength=longest + 1).tolist()
        self.mask = sum(1 << z for z, n in enumerate(self.count) if n)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.mask ^= 1 << size

    def filled(self, room: int) -> int:
        """What a trial filling puts into ``room``, largest first."""
        left = most = room
        while most > 0 and (fits := self.mask & ((2 << most) - 1)):
            size = fits.bit_length() - 1
            if not size:
                break
            left -= size * min(self.count[size], left // size)
            most = min(left, size - 1)
        return room - left


Packing = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def best_packing(sizes: np.ndarray, lengths: Sequence[int]) -> Packing:
    """The cheapest of :func:`best_fit` with all lengths to open, and with each one and the longest; the first of equals."""
    longest = max(lengths)
    ways = [set(lengths), *({c, longest} for c in sorted(lengths))]
    ways = [w for n, w in enumerate(ways) if w not in ways[:n]]
    return min((best_fit(sizes, lengths, sorted(w)) for w in ways), key=lambda found: sum(map(cost, found[2].tolist())))


def best_fit(sizes: np.ndarray, lengths: Sequence[int], opens: Sequence[int] | None = None) -> Packing:
    """Pack pieces of 1 to max(lengths) tokens into bins that open with one of ``opens`` (default: any length).

    Returns each piece's bin, its offset there, and each bin's final length and
    contents. Open bins are listed by free space; a bit for each space in use
    finds the tightest fit in one step. Of equally tight bins the one that came
    to that space last, of equally cheap lengths the smaller is taken.
    """
    lengths = sorted(lengths)
    opens = opens or lengths
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    mask, stock = 0, _Stock(sizes.astype(np.int64), lengths[-1])

    def expected(length: int, size: int) -> float:
        content = size + stock.filled(length - size)
        return cost(lengths[bisect_left(lengths, content)]) / content

    for i in order.tolist():
        size = int(sizes[i])
        stock.take(size)
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = room[space].pop()
            if not room[space]:
                mask &= ~(1 << space)
        else:
            space = min((c for c in opens if c >= size), key=lambda c: (expected(c, size), c))
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if free := space - size:
            room[free].append(b)
            mask |= 1 << free
    final = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, final.astype(np.int64), np.array(used, np.int64)


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, doc_id: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each piece of each document that has words.

    ``(bin, bin_length, bin_used, at, doc_id, piece, first_word, words)``: bin is
    a string, unique over the result; the piece holds ``words`` words of the
    document from ``first_word`` on and lies in the bin at word ``at``. Documents
    longer than the longest permitted length are cut into pieces of that length
    and a rest; no word is lost or repeated. Null and empty texts have no
    pieces. Repeated rows are packed each; a null doc_id stays null. Other
    columns are ignored; an empty table gives no rows.

    Pieces are dealt by hash over groups of about ``group_rows``, packed one
    group to a task; only ids and lengths are shuffled, so no source or group of
    copies gathers in one task.
    """
    longest = max(lengths)
    kind = docs.schema[doc_id].dataType.simpleString()
    sized = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.xxhash64(text).alias("h"), word_count(F.col(text).cast("string")).alias("n")).where("n > 0")
    pieces = sized.select("doc_id", "h", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest))).alias("piece"))
    pieces = pieces.select("doc_id", "h", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("first_word"), F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("words"))
    pieces = stage(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    placed = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(groups)).cast("int"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "h", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, at, length, used = best_packing(pdf["words"].to_numpy(), lengths)
        out = pdf[["doc_id", "piece", "first_word", "words"]].copy()
        out["bin"] = [f"{key[0]}-{b}" for b in bins.tolist()]
        out["bin_length"], out["bin_used"], out["at"] = length[bins], used[bins], at
        return out[["bin", "bin_length", "bin_used", "at", "doc_id", "piece", "first_word", "words"]]

    packed = placed.groupBy("g").applyInPandas(pack, "bin string, bin_length long, bin_used long, at long, doc_id string, piece int, first_word long, words long")
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))


def utilisation(packed: DataFrame) -> DataFrame:
    """``(bin_length, bins, words, utilisation, cost)`` of a packing: a row for each length in use."""
    length = F.col("bin_length")
    price = START_COST + length * (1 + F.lit(ATTENTION) * length)
    found = packed.where("at = 0").groupBy("bin_length").agg(F.count(F.lit(1)).alias("bins"), F.sum("bin_used").alias("words"))
    return found.select("bin_length", "bins", "words", (F.col("words") / (F.col("bins") * length)).alias("utilisation"), (F.col("bins") * price).alias("cost"))
