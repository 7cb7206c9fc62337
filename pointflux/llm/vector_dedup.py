"""Near-duplicate vectors through navigable small-world graphs, one per shard.

Equal vectors of a label count once. The distinct vectors of a label are dealt
over shards of a bounded size; each shard gets a hierarchical graph, and every
vector queries the graph of every shard of its label. A search's beam doubles
while it is full of links, and for a pair of shards until audited queries find
their brute-force links; where no beam does, the pair is compared by brute
force. Cosines are verified in double precision.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stage

#: Vectors in a shard, about.
SHARD_ROWS = 16_384
LINKS = 12
#: Candidates for a node's links, the narrowest beam of a search, rows linked and queries answered at a time.
BUILD, BEAM, BLOCK, QUERIES = 48, 12, 512, 256
#: The widest beam that is still cheaper than comparing a query with a whole shard.
WIDE = 96
AUDITS = 48
RECALL = 0.98
#: The graphs work in single precision.
SLACK = 1e-5


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors.

    Nodes are inserted in order and link to neighbours among those before them, on
    every layer up to their own; candidates are found exactly, block by block, not
    by a search of the graph so far. Searches run for many queries at once.
    """

    def __init__(self, unit: np.ndarray, m: int = LINKS, build: int = BUILD, seed: int = 11) -> None:
        self.x = unit
        rng = np.random.default_rng(seed)
        top = np.minimum((-np.log(rng.random(len(unit)) + 1e-300) / math.log(m)).astype(int), 12)
        layers = int(top.max()) + 1 if len(unit) else 0
        #: Neighbours of each node on each layer, -1 where there is none.
        self.layers = [self._link(np.flatnonzero(top >= n), m, 2 * m if n == 0 else m, build) for n in range(layers)]
        self.entry = int(top.argmax()) if len(unit) else -1

    def _link(self, members: np.ndarray, m: int, cap: int, build: int) -> np.ndarray:
        x = self.x[members]
        graph: list[list[int]] = [[] for _ in members]

        def cut(j: int) -> list[int]:
            near = np.array(graph[j])
            s = x[near] @ x[j]
            order = np.argsort(-s, kind="stable")
            return self._pick(x, near[order], s[order], cap)

        for a in range(0, len(members), BLOCK):
            b = min(a + BLOCK, len(members))
            s = x[a:b] @ x[:b].T
            s[:, a:][np.triu_indices(b - a)] = -2.0  # nodes before only
            most = min(build, b)
            near = np.argpartition(-s, most - 1, axis=1)[:, :most]
            s = np.take_along_axis(s, near, 1)
            order = np.argsort(-s, axis=1, kind="stable")
            near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
            for r in range(b - a):
                n = min(a + r, most)
                graph[a + r] = self._pick(x, near[r, :n], s[r, :n], m)
                for j in graph[a + r]:
                    graph[j].append(a + r)
                    if len(graph[j]) > 2 * cap:
                        graph[j] = cut(j)
        out = np.full((len(self.x), cap), -1, np.int32)
        for j in range(len(members)):
            own = cut(j) if len(graph[j]) > cap else graph[j]
            out[members[j], : len(own)] = members[own]
        return out

    @staticmethod
    def _pick(x: np.ndarray, near: np.ndarray, s: np.ndarray, m: int) -> list[int]:
        """Of candidates, best first, those closer to the node than to one another, then the closest of the rest."""
        if len(near) <= m:
            return near.tolist()
        between = x[near] @ x[near].T
        closest, at = between[0].copy(), [0]
        while len(at) < m:
            free = closest[at[-1] + 1 :] < s[at[-1] + 1 :]
            if not free.any():
                break
            at.append(at[-1] + 1 + int(free.argmax()))
            np.maximum(closest, between[at[-1]], out=closest)
        chosen = set(at)
        at += [k for k in range(len(near)) if k not in chosen][: m - len(at)]
        return near[at].tolist()

    def _beams(self, q: np.ndarray, start: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and numbers of the ``beam`` best nodes that each query finds from its start, in no order; -2 and -1 where there are fewer."""
        graph, x, n = self.layers[layer], self.x, len(q)
        every = np.arange(n)[:, None]
        seen = np.zeros((n, len(x)), bool)
        best = np.full((n, beam), -1, np.int32)
        score = np.full((n, beam), -2.0, np.float32)
        todo = np.zeros((n, beam), bool)
        best[:, 0], score[:, 0], todo[:, 0] = start, np.einsum("qd,qd->q", x[start], q), True
        seen[every[:, 0], start] = True
        rows = every[:, 0]
        while True:
            open_ = np.where(todo[rows], score[rows], -3.0)
            at = open_.argmax(1)
            live = open_[np.arange(len(rows)), at] > -3.0
            rows, at = rows[live], at[live]
            if not len(rows):
                return score, best
            todo[rows, at] = False
            near = graph[best[rows, at]]
            fresh = (near >= 0) & ~seen[rows[:, None], near]
            seen[rows[:, None], np.where(near >= 0, near, best[rows, at][:, None])] = True
            s = np.where(fresh, np.einsum("qkd,qd->qk", x[near], q[rows]), -2.0).astype(np.float32)
            both, ids = np.concatenate([score[rows], s], 1), np.concatenate([best[rows], np.where(fresh, near, -1)], 1)
            flags = np.concatenate([todo[rows], fresh], 1)
            keep = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
            score[rows], best[rows], todo[rows] = (np.take_along_axis(v, keep, 1) for v in (both, ids, flags))

    def near(self, q: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """For each query the nodes with similarity ``least`` or more; a beam widens while it holds nothing else.

        A query that fills a beam of WIDE has so many links that comparing it with
        every node costs less than a wider beam; that finds them all.
        """
        if self.entry < 0:
            return [np.zeros(0, np.int64)] * len(q)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        for a in range(0, len(q), QUERIES):
            rows = np.arange(a, min(a + QUERIES, len(q)))
            start = np.full(len(rows), self.entry)
            for layer in range(len(self.layers) - 1, 0, -1):
                start = self._beams(q[rows], start, 1, layer)[1][:, 0]
            wide = beam
            while len(rows):
                score, best = self._beams(q[rows], start, min(wide, len(self.x)), 0)
                good = score >= least
                for r, ids, g in zip(rows.tolist(), best, good, strict=True):
                    out[r] = ids[g].astype(np.int64)
                more = good.all(1) & (wide < len(self.x))
                rows, start, wide = rows[more], start[more], wide * 2
                if wide > max(WIDE, beam):
                    for r, hit in zip(rows.tolist(), q[rows] @ self.x.T >= least, strict=True):
                        out[r] = np.flatnonzero(hit)
                    break
        return out


def valid(vector: Column) -> Column:
    """Whether a vector can link: not null or empty, no null, NaN or infinite component, not all zero."""
    v = vector
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def _forest(edges: Iterator[tuple[int, np.ndarray]], nodes: np.ndarray) -> list[tuple[int, int]]:
    """Of edges from a node to several others those that join something: one fewer than the nodes of each component."""
    nodes = np.unique(nodes)
    part, kept = np.arange(len(nodes)), []
    for v, others in edges:
        own, there = part[np.searchsorted(nodes, v)], part[np.searchsorted(nodes, others)]
        joins = there != own
        if joins.any():
            new, first = np.unique(there[joins], return_index=True)
            kept += [(min(v, o), max(v, o)) for o in others[joins][first].tolist()]
            part[np.isin(part, new)] = own
    return kept


class Pairs:
    """A bit for each pair of a vector of one shard and a vector of another or the same one: 32 MB for two full shards."""

    def __init__(self, n: int, m: int, same: bool) -> None:
        self.bits, self.m, self.same = np.zeros((n, (m + 7) // 8), np.uint8), m, same

    def add(self, row: int, cols: np.ndarray, turned: bool = False) -> None:
        """Link ``row`` with ``cols``; ``turned``: ``row`` is of the second shard, ``cols`` are of the first."""
        if not turned:
            line = np.zeros(self.m, bool)
            line[cols] = True
            self.bits[row] |= np.packbits(line)
        if turned or self.same:
            self.bits[cols, row >> 3] |= np.uint8(128 >> (row & 7))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in np.nonzero(self.bits.any(1))[0].tolist():
            yield i, np.nonzero(np.unpackbits(self.bits[i], count=self.m))[0]


class Shard:
    """Vectors of a label with their numbers, their copies and their graph."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.copies, self.x = ids, copies, x
        self.norms = np.sqrt((x * x).sum(1))
        self.unit = (x / self.norms[:, None]).astype(np.float32)
        self.graph = SmallWorld(self.unit)


def _graph_links(queries: Shard, index: Shard, rows: np.ndarray, least: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
    """What the graph of ``index`` finds for some queries, verified in double precision."""
    for a in range(0, len(rows), QUERIES):
        part = rows[a : a + QUERIES]
        for i, near in zip(part.tolist(), index.graph.near(queries.unit[part], least - SLACK, beam), strict=True):
            near = np.sort(near)
            yield i, near[((index.x[near] @ queries.x[i]) / (index.norms[near] * queries.norms[i]) >= least) & (index.ids[near] != queries.ids[i])]


def _all_links(queries: Shard, index: Shard, rows: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """All links of some queries, by brute force in blocks."""
    for at in range(0, len(rows), AUDITS):
        block = rows[at : at + AUDITS]
        hits = (queries.x[block] @ index.x.T) / (queries.norms[block][:, None] * index.norms) >= least
        hits &= queries.ids[block][:, None] != index.ids
        for i, hit in zip(block.tolist(), hits, strict=True):
            yield i, np.nonzero(hit)[0]


def _audited_beam(queries: Shard, index: Shard, audits: list[tuple[int, np.ndarray]], least: float) -> tuple[int | None, int]:
    """The smallest doubling of BEAM at which audited queries find RECALL of their links, of all and on average, and what they find then; no beam: none does."""
    rows, whole = np.array([i for i, _ in audits], int), sum(len(t) for _, t in audits)
    beam = BEAM
    while beam < 2 * len(index.ids):
        hits = [len(np.intersect1d(t, near, assume_unique=True)) for (_, t), (_, near) in zip(audits, _graph_links(queries, index, rows, least, beam), strict=True)]
        if sum(hits) >= RECALL * whole and sum(h / len(t) for h, (_, t) in zip(hits, audits, strict=True)) >= RECALL * len(audits):
            return beam, sum(hits)
        beam *= 2
    return None, whole


def _search(queries: Shard, index: Shard, pairs: Pairs, least: float, turned: bool = False) -> tuple[bool, int, int]:
    """Enter links of ``queries`` with ``index`` into ``pairs``; whether these are all, by brute force, and audited links, in all and found.

    Queries are drawn and compared with all of ``index`` until AUDITS of them
    have links other than with themselves. If the graph finds those, it answers
    the queries not drawn; if no beam does, brute force answers them as well.
    """
    order = np.random.default_rng(5).permutation(len(queries.ids))
    audits: list[tuple[int, np.ndarray]] = []
    drawn = 0
    while drawn < len(order) and len(audits) < AUDITS:
        audits += [(i, t) for i, t in _all_links(queries, index, order[drawn : drawn + AUDITS], least) if len(t)]
        drawn += AUDITS
    for i, t in audits:
        pairs.add(i, t, turned)
    rest, truth = order[drawn:], sum(len(t) for _, t in audits)
    beam, hits = _audited_beam(queries, index, audits, least) if len(rest) else (None, truth)
    found = _all_links(queries, index, rest, least) if beam is None else _graph_links(queries, index, rest, least, beam)
    for i, near in found:
        if len(near):
            pairs.add(i, near, turned)
    return beam is None, truth, hits


def shard_links(a: Shard, b: Shard, least: float) -> tuple[dict[int, int], list[tuple[int, int]], tuple[int, int]]:
    """Linked copies by vector, a spanning forest of the links between two shards or within one, and audited links, in all and found.

    Each searches the other's graph; a link that one end's search found counts once for both ends.
    """
    same = a is b
    pairs = Pairs(len(a.ids), len(b.ids), same)
    whole, truth, hits = _search(a, b, pairs, least)
    if not whole and not same:
        _, t, h = _search(b, a, pairs, least, turned=True)
        truth, hits = truth + t, hits + h
    rows, cols = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)

    def edges() -> Iterator[tuple[int, np.ndarray]]:
        for i, near in pairs:
            rows[i] = b.copies[near].sum()
            cols[near] += a.copies[i]
            yield int(a.ids[i]), b.ids[near]

    forest = _forest(edges(), np.concatenate([a.ids, b.ids]))
    counts = {int(g): int(n) for g, n in zip(a.ids, rows) if n}
    if not same:
        counts |= {int(g): int(n) for g, n in zip(b.ids, cols) if n}
    return counts, forest, (truth, hits)


def near_links(distinct: DataFrame, least: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """What links ``distinct(gid, label, dim, vector, copies)`` at cosine ``least`` or more, without listing pairs.

    Rows ``(label, a, b, others, truth, hits)``: with ``b`` null, ``others`` copies are linked to vector
    ``a`` by what one task found; with both, an edge of a spanning forest of
    the links that one task found; with neither, the links of the queries it audited
    and how many of those its graphs found. A task finds all pairs of its two shards, from
    both ends, but returns as many rows as it has vectors, so a group of near
    copies of any size stays linear in what is written and shuffled.
    """
    groups = distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).select("label", "dim", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"))
    placed = distinct.join(groups, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("gid"), F.col("shards")).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gid")
        shard = Shard(pdf["gid"].to_numpy(), pdf["copies"].to_numpy(), np.stack(pdf["vector"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "shards": [int(pdf["shards"].iloc[0])], "graph": [pickle.dumps(shard, protocol=5)]})

    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema.fields}
    built = placed.groupBy("label", "dim", "shard").applyInPandas(build, f"label {kinds['label']}, dim int, shard int, shards int, graph binary")
    # One task for each pair of a label's shards, and for each shard with itself.
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")
    met = stage(built, "graphs").select("label", "dim", "shard", "graph", other)
    met = met.select("label", "dim", F.least("shard", "other").alias("p"), F.greatest("shard", "other").alias("q"), "graph")

    def search(met: pd.DataFrame) -> pd.DataFrame:
        shards = [pickle.loads(x) for x in met["graph"]]
        # A pair with a shard that got no vector has one row, though its shards differ.
        none = ({}, [], (0, 0))
        counts, edges, audit = shard_links(shards[0], shards[-1], least) if len(shards) == 2 or met["p"].iloc[0] == met["q"].iloc[0] else none
        n, m = len(counts), len(edges)
        return pd.DataFrame({
            "label": [met["label"].iloc[0]] * (n + m + 1),
            "a": pd.array([*counts, *(a for a, _ in edges), None], "Int64"),
            "b": pd.array([None] * n + [b for _, b in edges] + [None], "Int64"),
            "others": pd.array([*counts.values()] + [None] * (m + 1), "Int64"),
            "truth": pd.array([None] * (n + m) + [audit[0]], "Int64"),
            "hits": pd.array([None] * (n + m) + [audit[1]], "Int64"),
        })

    return met.groupBy("label", "dim", "p", "q").applyInPandas(search, f"label {kinds['label']}, a long, b long, others long, truth long, hits long")


def dedup_vectors(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, recall)`` for each row of ``vectors``.

    Rows link if their labels are equal and not null, their dimensions are equal
    and their cosine, in double precision, is ``least`` or more; the graphs find
    nearly all such pairs and no other pair links. Vectors that are null, empty,
    zero or hold a null, NaN or infinite component link with nothing. Rows with
    equal vectors link with one another and count each in ``n_links`` without
    being expanded into pairs; a link that either end's search found counts for
    both. ``component_id`` is the smallest vec_id reachable, ``kept`` whether it is the row's own; a null vec_id names no component and is
    kept only where nothing linked to it has an id. ``recall`` is the share of the
    audited queries' links that the graphs of the row's label found, by the beams
    that were then used; null where no query had links or no vector could link.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    rows = rows.withColumn("ok", valid(F.col("vector")) & F.col("label").isNotNull())
    sound = rows.where("ok").select("vec_id", "label", F.transform("vector", lambda v: v + 0.0).alias("vector"))
    grouped = sound.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    # Numbered once and written, so that every later read sees the same numbers.
    distinct = stage(grouped.withColumn("gid", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors")
    found = stage(near_links(distinct.select("gid", "label", "dim", "vector", "copies"), least, shard_rows), "links")
    roots = components(found.where("b is not null").select("a", "b"))
    direct = found.where("b is null and a is not null").groupBy(F.col("a").alias("gid")).agg(F.sum("others").alias("others"))
    rooted = distinct.select("gid", "first", "copies").join(roots.withColumnRenamed("v", "gid"), "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = rooted.join(named, "root").join(direct, "gid", "left").select("gid", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    facts = facts.join(distinct.select("gid", "label", "vector"), "gid").select("label", "vector", "n_links", "component_id")
    audits = found.where("truth > 0").groupBy("label").agg((F.sum("hits") / F.sum("truth")).alias("recall"))
    linked = sound.join(facts, ["label", "vector"]).join(audits, "label", "left").select("vec_id", "n_links", "component_id", "recall")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "recall")
