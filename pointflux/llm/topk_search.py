"""Exact top-k inner products by dual-tree search over cover trees.

The top level of the tree are centres, chosen farthest first on a bounded sample;
every row goes to its nearest one, and a centre's rows to shards of a bounded
size, each indexed once in a cover tree of its own. A query first searches a
shard of its own centre. Its worst kth score there then rules out every other
centre d with covering radius s for which <q,d> + s|q| is below it, before any
vector moves; the queries left for a shard are indexed in a tree as well, and
pairs of nodes are walked. With node centres c, d and radii r, s no pair below
them exceeds <c,d> + r|d| + s|c| + rs; a pair of nodes is dropped once that is
below the worst kth score of the query node. Scores are integers and exact.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARD_ROWS = 2_048
BLOCK_ROWS = 1_024
LEAF = 24
#: Rows of a dimension that its centres are chosen from, centres of a dimension, and dimensions, the fullest ones, that get centres.
SAMPLE, CENTRES, DIMENSIONS = 4_096, 256, 64
NONE = np.iinfo(np.int64).min


@dataclass
class Node:
    """Points ``rows`` within ``radius`` of ``centre``; a leaf has no children."""

    centre: np.ndarray
    size: float
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)
    worst: int = NONE


def _from(x: np.ndarray, norms: np.ndarray, rows: np.ndarray, c: int) -> np.ndarray:
    """Squared distances of ``rows`` from row ``c``; exact while the squares fit into 53 bits."""
    return np.maximum(norms[rows] + norms[c] - 2 * (x[rows] @ x[c]), 0.0)


def _node(x: np.ndarray, norms: np.ndarray, rows: np.ndarray, centre: int, far: np.ndarray) -> Node:
    return Node(x[centre], math.sqrt(norms[centre]), math.sqrt(far.max()) * (1 + 1e-9) + 1e-9, rows)


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None, norms: np.ndarray | None = None) -> Node:
    """The cover tree of the rows of ``x``.

    A node's children are centred on points more than half its covering radius
    apart that cover its points within half that radius, chosen farthest first,
    each point going to its nearest centre.
    """
    norms = (x * x).sum(1) if norms is None else norms
    rows = np.arange(len(x)) if rows is None else rows
    centre = int(rows[0]) if centre is None else centre
    far = _from(x, norms, rows, centre)
    node = _node(x, norms, rows, centre, far)
    if len(rows) <= LEAF or not far.any():
        return node
    half = far.max() / 4
    xs = np.ascontiguousarray(x[rows])
    owner, near, centres = np.zeros(len(rows), int), far, [centre]
    while near.max() > half:
        new = int(near.argmax())
        d = np.maximum(norms[rows] + norms[rows[new]] - 2 * (xs @ xs[new]), 0.0)
        closer = d < near
        owner[closer], near = len(centres), np.where(closer, d, near)
        centres.append(int(rows[new]))
    small: list[np.ndarray] = []
    for k, c in enumerate(centres):
        own = rows[owner == k]
        if len(own) > LEAF:
            node.children.append(cover_tree(x, own, c, norms))
        elif len(own):
            small.append(own)
    # In many dimensions most centres cover few points; such leaves of one level are kept together.
    for group in _together(small):
        node.children.append(_node(x, norms, group, int(group[0]), _from(x, norms, group, int(group[0]))))
    return node


def _together(small: list[np.ndarray]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for own in small:
        if out and len(out[-1]) + len(own) <= LEAF:
            out[-1] = np.concatenate([out[-1], own])
        else:
            out.append(own)
    return out


class Best:
    """The k best (score, smaller id first) of each query."""

    def __init__(self, n: int, k: int, worst: np.ndarray | None = None) -> None:
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.worst = np.full(n, NONE, np.int64) if worst is None else worst.copy()
        self.compared = 0

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        heap = self.heaps[q]
        for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
            item = (s, -i)
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        if len(heap) == self.k:
            self.worst[q] = max(self.worst[q], heap[0][0])


def dual_tree(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, tree: Node | None = None, worst: np.ndarray | None = None) -> Best:
    """The k best data rows of each query by integer inner product; a row's own id is no candidate.

    ``worst`` is what each query's kth score is known to reach; data scoring less is
    left out. ``tree`` is the data's cover tree, if it is there already.
    """
    best = Best(len(queries), k, worst)
    if not len(queries) or not len(data):
        return best
    qx = queries.astype(np.float64)

    def bound(a: Node, b: Node) -> float:
        top = float(a.centre @ b.centre) + a.radius * b.size + b.radius * a.size + a.radius * b.radius
        return top + 1e-6 * (1 + abs(top))  # never below the true bound, whatever the rounding

    def refresh(a: Node) -> None:
        a.worst = int(best.worst[a.rows].min())

    def compare(a: Node, b: Node) -> None:
        scores = queries[a.rows] @ data[b.rows].T
        best.compared += scores.size
        for at, q in enumerate(a.rows.tolist()):
            ok = (scores[at] >= best.worst[q]) & (data_ids[b.rows] != query_ids[q])
            if ok.any():
                best.offer(q, scores[at][ok], data_ids[b.rows][ok])
        refresh(a)

    def walk(a: Node, b: Node) -> None:
        if a.worst != NONE and bound(a, b) < a.worst:
            return
        if not a.children and not b.children:
            compare(a, b)
            return
        if a.children and (not b.children or a.radius >= b.radius):
            for child in a.children:
                walk(child, b)
            a.worst = min(c.worst for c in a.children)
            return
        for _, child in sorted(((-bound(a, c), n) for n, c in enumerate(b.children)), key=lambda t: t[0]):
            walk(a, b.children[child])

    def settle(a: Node) -> None:
        refresh(a)
        for child in a.children:
            settle(child)

    asked = cover_tree(qx)
    settle(asked)
    walk(asked, cover_tree(data.astype(np.float64)) if tree is None else tree)
    return best


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null, NaN or infinite component."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _centres(rows: DataFrame, shard_rows: int) -> dict[int, np.ndarray]:
    """The centres of each dimension with more rows than a shard holds; a few numbers for DIMENSIONS dimensions at most."""
    full = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).orderBy(F.desc("n"), "dim").limit(DIMENSIONS).collect()
    out = {}
    for dim, n in full:
        found = rows.where(F.col("dim") == dim).select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toPandas()["vector"]
        x = np.stack(found.to_numpy()).astype(np.float64)
        norms, chosen = (x * x).sum(1), [0]
        far = _from(x, norms, np.arange(len(x)), 0)
        while len(chosen) < min(CENTRES, -(-n // shard_rows)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _from(x, norms, np.arange(len(x)), chosen[-1]))
        out[dim] = x[chosen]
    return out


def _place(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with ``centre``, the nearest of its dimension (0: the origin, where there is none), and ``off``, the distance from it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = np.stack(part["vector"].to_numpy()).astype(np.float64) if dim else np.zeros((len(part), 0))
                c = centres.get(int(dim), np.zeros((1, int(dim))))
                near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
                yield part.assign(centre=near.astype(np.int32), off=np.sqrt(((x - c[near]) ** 2).sum(1)) * (1 + 1e-9) + 1e-9)

    return rows.mapInPandas(run, "vec_id long, asks boolean, vector array<long>, dim int, h long, centre int, off double")


def _trees(shards: DataFrame) -> DataFrame:
    """``(dim, centre, sub, tree)``: each shard's ids, vectors and cover tree, made once."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "h"])
        x = np.stack(pdf["vector"].to_numpy()).astype(np.int64)
        data = pickle.dumps((pdf["vec_id"].to_numpy(), x, cover_tree(x.astype(np.float64))), protocol=5)
        return pd.DataFrame({"dim": [key[0]], "centre": [key[1]], "sub": [key[2]], "tree": [data]})

    return shards.groupBy("dim", "centre", "sub").applyInPandas(build, "dim int, centre int, sub int, tree binary")


def _search(asked: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """``(query_id, h, vec_id, score)`` of ``asked(dim, centre, sub, block, vec_id, h, vector, worst)``, and for each search a row with a null query_id: pairs compared as vec_id, pairs in all as score."""
    keys = ["dim", "centre", "sub"]
    wanted = asked.select(*keys, "block").distinct()
    met = trees.join(wanted, keys).select(*[F.col(c).alias(f"t_{c}") for c in (*keys, "block")], "tree")

    def run(key: tuple, asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "h", "vec_id", "score"]
        if not len(asks) or not len(held):
            return pd.DataFrame({n: pd.array([], "Int64") for n in names})
        ids, x, tree = pickle.loads(held["tree"].iloc[0])
        asks = asks.sort_values(["vec_id", "h"])
        own, h = asks["vec_id"].to_numpy(), asks["h"].to_numpy()
        worst = asks["worst"].astype("Int64").fillna(NONE).to_numpy(np.int64)
        best = dual_tree(np.stack(asks["vector"].to_numpy()).astype(np.int64), own, x, ids, k, tree, worst)
        found = [(int(own[q]), int(h[q]), -i, s) for q, heap in enumerate(best.heaps) for s, i in heap]
        columns = zip(*found, (None, None, best.compared, len(own) * len(ids)), strict=True)
        return pd.DataFrame({n: pd.array(c, "Int64") for n, c in zip(names, columns, strict=True)})  # whole 64-bit numbers beside nulls

    by = [*keys, "block"]
    return asked.groupBy(*by).cogroup(met.groupBy(*[f"t_{c}" for c in by])).applyInPandas(run, "query_id long, h long, vec_id long, score long")


def _found(vectors: DataFrame, queries: Column, k: int, scale: int, vec_id: str, embedding: str, shard_rows: int, block_rows: int) -> DataFrame:
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", "asks", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector")).distinct()
    rows = stage(rows.withColumn("dim", F.size("vector")).withColumn("h", F.xxhash64("vector")), "vectors")
    centres = _centres(rows, shard_rows)
    placed = stage(_place(rows, centres), "placed")
    # A row for each centre: radius, shards.
    cells = placed.groupBy("dim", "centre").agg(F.max("off").alias("radius"), F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("subs"))
    cells = stage(cells, "cells")
    blocks = placed.where("asks").groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("vec_id", "h"), F.col("subs")).cast("int")
    shards = placed.join(cells, ["dim", "centre"]).withColumn("sub", own)
    trees = stage(_trees(shards.select("dim", "centre", "sub", "vec_id", "h", "vector")), "trees")
    asks = shards.where("asks").join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id", "h"), F.col("blocks")).cast("int"))
    asks = stage(asks.select("dim", "centre", "sub", "block", "vec_id", "h", "vector"), "asks")
    first = stage(_search(asks.withColumn("worst", F.lit(None).cast("long")), trees, k), "first")
    kth = first.where("query_id is not null").groupBy("query_id", "h").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    kth = kth.select(F.col("query_id").alias("vec_id"), "h", F.when(F.col("n") >= k, F.col("worst")).alias("worst"))
    known = asks.join(kth, ["vec_id", "h"], "left")
    # Radii are a number for each centre: CENTRES for DIMENSIONS dimensions at most; other dimensions have the origin only.
    radii = {(r["dim"], r["centre"]): r["radius"] for r in cells.where(F.col("dim").isin(list(centres))).collect()}

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                at = int(dim)
                if at not in centres:
                    yield part.assign(centres=[[0]] * len(part))
                    continue
                q = np.stack(part["vector"].to_numpy()).astype(np.float64)
                radius = np.array([radii.get((at, c), -1.0) for c in range(len(centres[at]))])
                top = q @ centres[at].T + np.sqrt((q * q).sum(1))[:, None] * radius
                top += 1e-6 * (1 + np.abs(top))  # never below the true bound, whatever the rounding
                worst = part["worst"].astype("Int64").fillna(NONE).to_numpy(np.int64).astype(np.float64)
                open_ = (top >= worst[:, None]) & (radius >= 0)
                yield part.assign(centres=[np.flatnonzero(o).tolist() for o in open_])

    kinds = "vec_id long, h long, dim int, centre int, sub int, block int, vector array<long>, worst long"
    admitted = known.select(*[c.split()[0] for c in kinds.split(", ")]).mapInPandas(admit, kinds + ", centres array<int>")
    there = admitted.select("dim", "block", "vec_id", "h", "vector", "worst", F.col("centre").alias("c0"), F.col("sub").alias("s0"), F.explode("centres").alias("centre"))
    there = there.join(cells.select("dim", "centre", "subs"), ["dim", "centre"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    others = there.where("centre <> c0 or sub <> s0").drop("c0", "s0", "subs")
    return first.union(_search(others, trees, k))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best rows, from rank 1.

    Components become floor(scale * x), x as double, and score is the integer
    inner product; ``queries`` picks the query rows. Higher scores come first,
    ties go to the smaller vec_id. A query's own vec_id is no candidate; fewer
    than ``k`` others give fewer ranks. Vectors that are null or hold null, NaN
    or infinite components, and rows with a null vec_id, take no part; vectors of
    another dimension are no candidates. A row repeated in id and vector counts
    once; an id with several vectors has each of them as query and candidate, and
    keeps the best ``k`` rows over all. Other columns are ignored.
    """
    near = _found(vectors, queries, k, scale, vec_id, embedding, shard_rows, block_rows).where("query_id is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_cost(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row ``(compared, met)``: pairs of query and row whose score :func:`top_k` computes, and pairs in the shards it visits."""
    found = _found(vectors, queries, k, scale, vec_id, embedding, shard_rows, block_rows).where("query_id is null")
    return found.agg(F.sum("vec_id").alias("compared"), F.sum("score").alias("met"))
