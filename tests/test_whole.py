"""Queries that cover whole tables, against brute force: the ones whose SQL leaves rows out have a twin without it."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pointflux import plans
from pointflux.functions import numeric
from pointflux.operators import mesh

SF = "/root/testdata/sf0.001"


def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "n_chars").collect()]


def test_rans_of_odd_texts(spark):
    from pointflux.plans.models import rans_round_trip

    texts = [None, "", "a", "é\U0001f600", "ab" * 50_000, "".join(map(chr, range(1, 2000)))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n, r.digest) for r in rans_round_trip(rows).collect()}
    assert got == {k: (None, None) if t is None else (len(t.encode()), hashlib.md5(t.encode()).hexdigest()) for k, t in enumerate(texts)}


def brute_components(triangles):
    """Triangles of components with at least max(24, 0.15 % of the largest, rounded down): (t, root, n)."""
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for _, *corners in triangles:
        for v in corners[1:]:
            x, y = find(corners[0]), find(v)
            root[max(x, y)] = min(x, y)
    sizes = Counter(find(a) for _, a, _, _ in triangles)
    need = max(24, math.floor(0.0015 * max(sizes.values())))
    return sorted((t, find(a), sizes[find(a)]) for t, a, _, _ in triangles if sizes[find(a)] >= need)


@pytest.mark.parametrize("largest", [40, 20_500])
def test_large_components(spark, largest):
    """Strips of triangles: just below and at 24, just below and at 30 (0.15 % of 20,500 is 30.75), and the largest."""
    rows, start = [], 0
    for k, n in enumerate((23, 24, 29, 30, largest)):
        rows += [(f"{k}/{i}", start + i, start + i + 1, start + i + 2) for i in range(n)]
        start += n + 10
    # Numbers dealt over the vertices, so that the smallest isn't at a strip's end.
    rows = [(t, *(v * 7919 % 1_000_003 for v in corners)) for t, *corners in rows] if largest < 1_000 else rows[:-largest] + [(f"4/{i}", start, start + i + 1, start + i + 2) for i in range(largest)]
    frame = spark.createDataFrame(rows, "t string, a long, b long, c long")
    got = sorted((r.t, r.root, r.n) for r in mesh.large_components(frame).collect())
    assert got == brute_components(rows)
    assert {n for _, _, n in got} == ({24, 29, 30, 40} if largest == 40 else {30, 20_500})


def lines(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").distinct().collect()
    return [(f"{3 * o}/{3 * p + 1}/{3 * s + 2}", 3 * o, 3 * p + 1, 3 * s + 2) for o, p, s in rows]


def test_large_components_of_all_lines(spark):
    got = sorted((r.t, r.root, r.n) for r in plans.QUERIES["F817_large_components"](spark, SF).collect())
    assert got == brute_components(lines(spark))


def test_border_of_all_lines(spark):
    count = Counter(tuple(sorted(e)) for _, a, b, c in lines(spark) for e in ((a, b), (b, c), (c, a)))
    got = sorted(tuple(r) for r in plans.QUERIES["F820_border_edges"](spark, SF).collect())
    assert got == sorted(e for e, n in count.items() if n == 1)
    assert 0 < len(got) < len(count)


def size_text(n):
    """Decimal units with one digit, ties rounded up."""
    for size, unit in ((10**9, "GB"), (10**6, "MB"), (10**3, "kB")):
        if n >= size:
            tenths = (20 * n + size) // (2 * size)
            return f"{tenths // 10}.{tenths % 10} {unit}"
    return f"{n} B"


def test_sizes_of_all_documents(spark):
    got = sorted(tuple(r) for r in plans.QUERIES["F721_format_bytes"](spark, SF).collect())
    assert got == sorted((d, size_text(n)) for d, _, n in docs(spark))


def test_size_units_and_ties(spark):
    sizes = [0, 999, 1000, 1049, 1050, 1149, 1150, 1250, 1950, 9950, 999_949, 999_950, 999_999, 10**6, 1_050_000, 1_149_999, 1_150_000, 999_950_000, 10**9, 1_250_000_000, 2**62]
    sizes += [k * 1000 + 50 + 100 * (k % 10) for k in range(1, 999, 7)]
    rows = spark.createDataFrame([(n,) for n in [*sizes, None]], "n long")
    got = {r.n: r.size for r in rows.select("n", numeric.format_bytes(F.col("n")).alias("size")).collect()}
    assert got == {None: None} | {n: size_text(n) for n in sizes}
    assert got[1150] == "1.2 kB" and got[999_950] == "1000.0 kB" and got[1_050_000] == "1.1 MB" and got[1_250_000_000] == "1.3 GB"
