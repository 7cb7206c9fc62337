"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the popcounts of 32 segments of two bits.
Flipping one bit moves one popcount by one, so the Manhattan distance of two
embeddings is a lower bound of the Hamming distance. The range join under that
bound runs on a grid: the 32 coordinates form four quarter-grids of eight, and
two points within Manhattan distance 2 differ in at most two coordinates, so
they share a cell in at least two of the quarter-grids. Joining on each of the
six pairs of quarters therefore meets every pair in range; the bound and then
the exact Hamming distance are conditions of that join.

Popcounts are kept in unary (0: 00, 1: 01, 2: 11), which turns the Manhattan
distance into the bit count of an exclusive or and a cell into a masked long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, new_path, stage

SEED = 42
LOW_BITS = 0x5555555555555555
QUARTER = 0xFFFF
MASKS = [(QUARTER << 16 * i) | (QUARTER << 16 * j) for i, j in combinations(range(4), 2)]
#: A cell with more fingerprints than this is joined by shared neighbours instead of by pairs.
CROWDED = 256
#: Shingles hashed at a time.
BLOCK = 65_536
#: Words of a shingle and least Jaccard similarity of near duplicates.
NEAR_WORDS, NEAR = 5, 0.8
#: Minima of a set of shingles, in bands: similar sets agree in a whole band.
BANDS, BAND_ROWS = 24, 5
#: Shingles of a part of a bucket; a task holds two parts.
PART = 262_144


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, words: int = 3) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of one text, repeats included, in blocks of unsigned 64-bit integers.

    Lower-cases A-Z, takes runs of anything but blank and \\x09-\\x0D as words and
    hashes every ``words``-word shingle (fewer words: the whole sequence; none: no
    block). Blocks bound what a very long text needs.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    stop = np.cumsum(lens + 1) - 1
    k = min(words, len(parts))
    h = xxhash.xxh64_intdigest
    start, stop = (stop - lens)[: len(parts) - k + 1].tolist(), stop[k - 1 :].tolist()
    for n in range(0, len(stop), BLOCK):
        spans = zip(start[n : n + BLOCK], stop[n : n + BLOCK], strict=True)
        yield np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64)


def _majority(blocks: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes: a bit is 1 if it is set in over half of them."""
    ones, total = np.zeros(64, np.int64), 0
    for block in blocks:
        total += len(block)
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of one text; null and white space only give 0."""
    return _majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs``; ``fp`` is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([_signed(fingerprint(t.as_py(), words)) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """The segment popcounts of a fingerprint in unary, two bits a segment."""
    right = F.shiftrightunsigned(fp, 1)
    low, both = fp.bitwiseOR(right), fp.bitwiseAND(right)
    return low.bitwiseAND(F.lit(LOW_BITS)).bitwiseOR(F.shiftleft(both.bitwiseAND(F.lit(LOW_BITS)), 1))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _cells(points: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col("t").bitwiseAND(F.lit(_signed(m))).alias("cell")) for k, m in enumerate(MASKS)])
    return points.select("fp", "t", F.explode(cells).alias("c")).select("fp", "t", "c.k", "c.cell")


def links(distinct_fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of "differs in at most two bits".

    ``distinct_fps(fp long)`` holds each fingerprint once. In cells of up to
    ``crowded`` fingerprints every pair is verified; fingerprints of fuller cells
    meet through shared neighbours: two fingerprints differ in at most two bits
    exactly if some value is at one bit or less from both, so each names its 65
    such values and links to the smallest fingerprint naming the same value. That
    is exact as well, and linear where pairs would be quadratic.
    """
    points = distinct_fps.select("fp", embed(F.col("fp")).alias("t"))
    cells = stage(_cells(points), "cells")
    full = cells.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("k", "cell", F.lit(True).alias("full"))
    marked = cells.join(full, ["k", "cell"], "left")
    sparse = marked.where("full is null").drop("full")
    a = sparse.select("k", "cell", F.col("fp").alias("a"), F.col("t").alias("ta"))
    b = sparse.select("k", "cell", F.col("fp").alias("b"), F.col("t").alias("tb"))
    bound = F.bit_count(F.col("ta").bitwiseXOR(F.col("tb"))) <= 2
    pairs = a.join(b, (a.k == b.k) & (a.cell == b.cell) & (F.col("a") < F.col("b")) & bound & (hamming(F.col("a"), F.col("b")) <= 2)).select("a", "b")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    named = marked.where("full").select("fp").distinct().select("fp", F.explode(flips).alias("via"))
    least = named.groupBy("via").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("via", "a")
    stars = named.join(least, "via").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars)


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, crowded: int = CROWDED) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Rows link if their fingerprints differ in at most two bits; ``component_id``
    is the smallest doc_id reachable, the row's own included. Texts that are null,
    empty or white space only have fingerprint 0 and link like any other. Equal
    fingerprints count once in every join, so copies add no pairs. Rows with a
    null doc_id keep a row, link like any other and never name a component
    (null if no row reachable has an id); repeated doc_ids keep each of their rows.
    Other columns are ignored; an empty table gives no rows.
    """
    fps = stage(fingerprints(docs, doc_id, text, words), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct", new_path(docs.sparkSession, "distinct"))
    roots = components(links(distinct.select("fp"), crowded))
    rooted = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = stage(rooted.join(named, "root").select("fp", "component_id"), "components")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: str | None, words: int, factors: np.ndarray) -> tuple[str, int, int, list[int]]:
    """``(key, n, fp, bands)`` of one text's set of shingles.

    ``key`` is a 128-bit digest of the set and ``n`` its size; ``fp`` is the
    fingerprint of all shingles; ``bands`` digests the set's minima under
    ``factors`` band by band. No words: an empty set without bands.
    """
    blocks = list(shingle_hashes(text, words))
    if not blocks:
        return "", 0, 0, []
    found = np.unique(np.concatenate(blocks))
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for n in range(0, len(found), 1024):
        np.minimum(least, (found[n : n + 1024, None] * factors).min(0), out=least)
    bands = [_signed(xxhash.xxh64_intdigest(b.tobytes(), i)) for i, b in enumerate(least.reshape(-1, BAND_ROWS))]
    return xxhash.xxh128_hexdigest(found.tobytes()), len(found), _signed(_majority(blocks)), bands


def _sketches(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for batch in batches:
            rows = [sketch(t.as_py(), words, factors) for t in batch.column("text")]
            key, n, fp, bands = zip(*rows, strict=True) if rows else ((), (), (), ())
            arrays = [batch.column("doc_id"), batch.column("t"), pa.array(key, pa.string()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "t", "key", "n", "fp", "bands"])

    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("t"), body.alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, t long, key string, n long, fp long, bands array<long>")


def _shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """``(key, shingles)`` of each row's ``text`` whose set of shingles has the digest ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, seen = [], [], set()  # rows alike come once a task

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])
            keys.clear(), sets.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                if key.as_py() in seen:
                    continue
                seen.add(key.as_py())
                keys.append(key.as_py())
                sets.append(np.unique(np.concatenate(list(shingle_hashes(text.as_py(), words)))).view(np.int64))
                if sum(map(len, sets[-16:])) > BLOCK or len(sets) >= 1024:
                    yield done()
        yield done()

    return rows.select("key", "text").mapInArrow(run, "key string, shingles array<long>")


def similar_sets(keys: list[str], sides: list[int], sets: list[np.ndarray], least: float) -> list[tuple[str, str]]:
    """A spanning forest of the links among sets of Jaccard similarity ``least`` or more.

    With sets of both sides, those of one side meet those of the other only.
    """
    order = sorted(range(len(keys)), key=lambda i: (sides[i], keys[i]))
    keys, sets = [keys[i] for i in order], [sets[i] for i in order]
    zero = sum(s == 0 for s in sides)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    inside, root, edges = np.zeros(len(names), bool), list(range(len(keys))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(min(zero, len(keys) - 1)):
        mine, k = flat[starts[i] : starts[i] + sizes[i]], zero if zero < len(keys) else i + 1
        inside[mine] = True
        common = np.add.reduceat(inside[flat[starts[k] :]], starts[k:] - starts[k], dtype=np.int64)
        inside[mine] = False
        for j in np.flatnonzero(common >= least * (sizes[i] + sizes[k:] - common) - 1e-9) + k:
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((keys[i], keys[j]))
    return edges


def _verified(members: DataFrame, least: float) -> DataFrame:
    """Edges ``(a, b)`` from rows ``(bucket, p, q, side, key, shingles)``, one search for each bucket, p and q.

    Rows of a search arrive together, so a task holds two parts of a bucket at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sides, sets = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if edges := similar_sets(keys, sides, sets, least) if len(keys) > 1 else []:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            places = zip(*[batch.column(c).to_pylist() for c in ("bucket", "p", "q", "side", "key")], strict=True)
            for (*place, side, key), shingles in zip(places, batch.column("shingles"), strict=True):
                if place != now:
                    yield from done()
                    now, keys, sides, sets = place, [], [], []
                keys.append(key)
                sides.append(side)
                sets.append(shingles.values.to_numpy())
        yield from done()

    return members.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(run, "a string, b string")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = NEAR_WORDS, least: float = NEAR, part: int = PART) -> DataFrame:
    """``(doc_id, t, component_id, keeper_t)`` for each row of ``docs``; ``t`` is the text's xxhash64.

    Rows link if their sets of ``words``-word shingles have a Jaccard similarity of
    ``least`` or more; ``component_id`` is the smallest doc_id reachable and
    ``keeper_t`` the ``t`` of the row that has it. Rows without an id link like any
    other; where no row reachable has one, component_id is null. Texts without
    words link with each other, shorter ones by their whole sequence.

    Fingerprints at two bits or less, found by the popcount embedding, name the
    closest candidates. Pairs at 0.8 are up to 14 of 64 bits apart, where no grid
    over fingerprints still separates them, so sets that agree in a band of minima
    are candidates too: 24 bands of five miss a pair at 0.8 once in 14,000, and
    closer ones less. Every candidate is verified on whole sets. Equal sets count
    once; buckets with the same members are searched once, and one of over
    ``part`` shingles part against part. Only spanning forests leave a search.
    """
    rows = stage(_sketches(docs, doc_id, text, words), "sketches")
    # Rows with an id come first, then the smallest id, then the text's hash.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    sets = stage(rows.groupBy("key").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "sets")
    full = sets.where("n > 0")
    groups = components(links(full.select("fp").distinct())).select(F.col("v").alias("fp"), "root")
    by_fp = full.join(groups, "fp", "left").select("key", "n", F.xxhash64(F.lit(-1), F.coalesce("root", "fp")).alias("bucket"))
    by_band = full.select("key", "n", F.posexplode("bands").alias("i", "band")).select("key", "n", F.xxhash64("i", "band").alias("bucket"))
    named = stage(by_fp.union(by_band), "buckets")
    mark = F.xxhash64("key")
    buckets = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.bit_xor(mark).alias("x"), F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("m > 1")
    once = buckets.groupBy("m", "total", "x", "lo", "hi").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("total") / part).cast("int").alias("parts"))
    places = stage(named.join(once, "bucket").select("bucket", "key", "parts"), "places")
    wanted = places.select("key").distinct().join(sets, "key").select("key", F.col("first.doc_id").alias("_first"), F.col("first.t").alias("t"))
    body = F.col(text).cast("string")
    texts = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(body).alias("_t"), body.alias("text"))
    texts = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_t") == F.col("t")))
    shingled = stage(_shingle_sets(texts, words), "shingles").dropDuplicates(["key"])
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side")))
    dealt = places.withColumn("own", own).select("bucket", "key", F.explode(met).alias("to")).select("bucket", "key", "to.*")
    edges = _verified(dealt.join(shingled, "key").select("bucket", "p", "q", "side", "key", "shingles"), least)
    roots = components(edges).select(F.col("v").alias("key"), "root")
    rooted = stage(sets.select("key", "first").join(roots, "key", "left").select("key", "first", F.coalesce("root", "key").alias("root")), "rooted")
    least_ids = rooted.groupBy("root").agg(F.min("first").alias("keeper"))
    named = rows.join(rooted.join(least_ids, "root").select("key", "keeper"), "key")
    return named.select("doc_id", "t", F.col("keeper.doc_id").alias("component_id"), F.col("keeper.t").alias("keeper_t"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """One row of ``docs`` for each group of :func:`near_copies`, all columns unchanged.

    The row with the smallest doc_id stays; among several texts of that id, the
    one smallest by hash; rows without an id come after all others. Of rows alike
    in id and text the one smallest by a hash of all columns stays.
    """
    found = near_copies(docs, doc_id, text, **options)
    keeps = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("t") == F.col("keeper_t"))
    marks = found.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"), F.bool_and(keeps).alias("keeps")).where("n > 1 or not keeps")
    marks = stage(marks.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), F.col("keeps").alias("_twice")), "marks")
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col(doc_id).alias("_doc"), F.xxhash64(F.col(text).cast("string")).alias("_hash"))
    kept = rows.join(marks, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_t")), "left").where("_twice is null or _twice")
    if marks.where("_twice").limit(1).count():
        place = F.row_number().over(Window.partitionBy("_doc", "_hash").orderBy(F.xxhash64("_row")))
        twice = kept.where("_twice").withColumn("_at", place).where("_at = 1").drop("_at")
        kept = kept.where("_twice is null").unionByName(twice)
    return kept.select("_row.*")
