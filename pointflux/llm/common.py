"""What several training-data operators share: words, running sums and cuts of long texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.graph import components  # noqa: F401
from ..storage import discard, new_path, scratch, shared_dir, stage  # noqa: F401

#: White space as the contracts define it: blank and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

def word_count(text: Column) -> Column:
    """Words of a text (null: none), counted without building an array of them."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(marked, GAP, "")).cast("long")


def bound(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, larger: bool = False) -> Column:
    """Running sums, or running maxima, of an array of numbers.

    Doubling steps: in step j every element takes in the one 2**j places before,
    so n elements cost n log n. A fold that appends to an array would copy it at
    every step.
    """
    join = (lambda x, y: F.greatest(x, y)) if larger else (lambda x, y: x + y)
    steps = lambda v: F.when(F.size(v) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(v: Column, j: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), j)
        return F.transform(v, lambda x, i: F.when(i >= far, join(x, F.get(v, i - far))).otherwise(x))

    return bound(values, lambda v: F.aggregate(steps(v), v, step))


#: Code points of a piece of a cut text.
PIECE = 1_024


def pieces(text: Column) -> Column:
    """``text`` in pieces of PIECE code points, for :func:`cut`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` on of a text in :func:`pieces`; reads no more than the pieces they lie in."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((start + length) / PIECE).cast("int")
    return F.substr(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), start - first * PIECE + 1, length)
