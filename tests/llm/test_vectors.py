"""Vector search and near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointflux.llm import topk_search, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, gid long, dim int, vector string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab, 1, 2, "x") for i, v, lab in rows], SCHEMA)


def clouds(n=400, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * 0.05
    return [(i, x[i].astype(np.float32).tolist(), int(i % 3)) for i in range(n)]


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0] * 15 + [None], 1), (9004, [1.0] * 15 + [float("nan")], 1), (9005, [1.0] * 15 + [float("inf")], 1), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (9008, [1.0] * 16, None), (9009, [1.0] * 16, None), (9010, [], 1)]


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_dedup_against_brute_force(spark, shard_rows):
    rows = clouds() + ODD + [(5000 + k, clouds()[0][1], 0) for k in range(30)] + [(7, clouds()[7][1], 1)]
    got = vector_dedup.dedup_vectors(table(spark, rows), shard_rows=shard_rows).collect()
    assert len(got) == len(rows)
    ok = [k for k, (_, v, lab) in enumerate(rows) if sound(v) and any(v) and lab is not None]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    total = 0
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    n[a] += 1
                    n[b] += 1
                    total += 2
                    root[find(b)] = find(a)
    want = {}
    for k, (i, _, _) in enumerate(rows):
        want[find(k)] = min(i, want.get(find(k), i))
    links = sum(r.n_links for r in got)
    assert 0.97 * total <= links <= total and total > 500
    exact = sorted((rows[k][0], want[find(k)]) for k in range(len(rows)))
    assert np.mean([a == b for a, b in zip(sorted((r.vec_id, r.component_id) for r in got), exact)]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    alone = {r.vec_id: r for r in got if r.vec_id in (9001, 9002, 9003, 9004, 9005, 9008, 9009, 9010)}
    assert all(r.n_links == 0 and r.kept for r in alone.values()) and len(alone) == 8


def near_copies():
    """Six groups of 120 near copies, on which graph searches are not symmetric."""
    rng = np.random.default_rng(2)
    c = rng.normal(size=(6, 8))
    x = np.repeat(c / np.sqrt((c * c).sum(1))[:, None], 120, 0) + rng.normal(size=(720, 8)) * 0.02
    return x.astype(np.float32).astype(float)


def real_links(a, b):
    return ((a.x @ b.x.T) / (a.norms[:, None] * b.norms) >= 0.98) & (a.ids[:, None] != b.ids)


def found_links(a, b):
    found = np.zeros((len(a.ids), len(b.ids)), bool)
    for i, near in enumerate(b.graph.near(a.unit, 0.98 - 1e-5, vector_dedup.BEAM)):
        found[i, near] = True
    return found & real_links(a, b)


class OneWay:
    """A graph that loses one link in about a hundred, another one from each end."""

    def __init__(self, x):
        self.x = x

    def near(self, q, least, beam):
        s = q @ self.x.T
        own = s.argmax(1)
        return [np.nonzero((row >= least) & ((np.arange(len(self.x)) * 7 + o * 13) % 97 != 0))[0] for row, o in zip(s, own)]


@pytest.mark.parametrize("parts", [1, 2])
def test_links_count_for_both_ends(parts):
    x, ids, copies = near_copies(), np.arange(720), np.arange(720) % 3 + 1
    shards = [vector_dedup.Shard(ids[k::parts], copies[k::parts], x[k::parts]) for k in range(parts)]
    for s in shards:
        s.graph = OneWay(s.unit)
    a, b = shards[0], shards[-1]
    there, back = found_links(a, b), found_links(b, a).T
    assert parts == 2 or (there != back).any()
    least, most = (there | back), real_links(a, b)
    counts, forest, audit = vector_dedup.shard_links(a, b, 0.98)
    for side, turn in ((a, np.asarray), (b, np.transpose)):
        other = b if side is a else a
        got = np.array([counts.get(g, 0) for g in side.ids.tolist()])
        assert (turn(least) @ other.copies <= got).all() and (got <= turn(most) @ other.copies).all()
    assert len(forest) < 720 and 0.98 * audit[0] <= audit[1] <= audit[0]


def rare_links(n=900, pairs=61):
    """Few links, all of them rare among the audited vectors."""
    x = np.random.default_rng(6).normal(size=(n, 12))
    x[:pairs] = x[pairs : 2 * pairs] + np.random.default_rng(7).normal(size=(pairs, 12)) * 0.02
    return x


class Cut:
    """A graph that never reaches one node in ``every``, whatever the beam."""

    def __init__(self, x, every=2):
        self.x, self.every = x, every

    def near(self, q, least, beam):
        hits = q @ self.x.T >= least
        hits[:, 1 :: self.every] = False
        return [np.nonzero(h)[0] for h in hits]


@pytest.mark.parametrize("x", [rare_links(), near_copies()], ids=["rare", "groups"])
@pytest.mark.parametrize("parts", [1, 2])
@pytest.mark.parametrize("every", [2, 5])
def test_links_of_a_cut_graph(x, parts, every):
    """A link in two or in five lost: the audit fails, and brute force finds all."""
    shards = [vector_dedup.Shard(np.arange(len(x))[k::parts], np.ones(len(x), int)[k::parts], x[k::parts]) for k in range(parts)]
    for s in shards:
        s.graph = Cut(s.unit, every)
    a, b = shards[0], shards[-1]
    counts, _, _ = vector_dedup.shard_links(a, b, 0.98)
    real = real_links(a, b)
    assert real.any()
    want = dict(zip(a.ids.tolist(), real.sum(1).tolist())) | dict(zip(b.ids.tolist(), real.sum(0).tolist()))
    assert counts == {g: n for g, n in want.items() if n}


def test_audits_have_links_of_their_own():
    """Self hits and queries without links decide nothing: the beam is the smallest that finds the drawn links."""
    x = near_copies()
    a = vector_dedup.Shard(np.arange(720), np.ones(720, int), x)
    audits = [(i, t) for i, t in vector_dedup._all_links(a, a, np.arange(0, 720, 15), 0.98)]
    assert all(i not in t and len(t) for i, t in audits)
    beam, hits = vector_dedup._audited_beam(a, a, audits, 0.98)
    near = dict(vector_dedup._graph_links(a, a, np.array([i for i, _ in audits]), 0.98, beam))
    found = sum(len(set(t.tolist()) & set(near[i].tolist())) for i, t in audits)
    assert found == hits and found >= vector_dedup.RECALL * sum(len(t) for _, t in audits)
    a.graph = Cut(a.unit)
    assert vector_dedup._audited_beam(a, a, audits, 0.98)[0] is None


def test_graph_finds_neighbours_and_isolated_groups():
    """Graph searches against brute force, on scattered vectors, on groups of copies and on graphs of one or two nodes."""
    rng = np.random.default_rng(12)
    for x in (rng.normal(size=(1500, 16)), np.repeat(rng.normal(size=(40, 16)), 30, 0) + rng.normal(size=(1200, 16)) * 0.05, rng.normal(size=(1, 16)), rng.normal(size=(2, 16))):
        unit = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
        graph = vector_dedup.SmallWorld(unit)
        assert graph.layers[0].shape == (len(x), 24) and all((g < len(x)).all() for g in graph.layers)
        s = unit @ unit.T
        least = np.sort(s, axis=1)[:, -min(8, len(x))].mean()
        got = graph.near(unit, least, 48)
        hit = sum(np.isin(np.nonzero(s[i] >= least)[0], got[i]).sum() for i in range(len(x)))
        assert hit >= 0.95 * (s >= least).sum() and all((s[i][g] >= least - 1e-5).all() for i, g in enumerate(got))


def test_recall_is_reported(spark):
    rows = clouds()
    got = vector_dedup.dedup_vectors(table(spark, rows + ODD[:2]), shard_rows=60).collect()
    assert all(r.recall is None if r.vec_id > 9000 else 0.98 <= r.recall <= 1 for r in got)


def test_dedup_empty(spark):
    assert vector_dedup.dedup_vectors(table(spark, [])).count() == 0
    assert vector_dedup.dedup_vectors(table(spark, ODD[:2])).count() == 2


@pytest.mark.parametrize("sizes", [(2_048, 1_024), (70, 3)])
def test_topk_against_brute_force(spark, sizes):
    rows = clouds() + ODD + [(5000 + k, clouds()[0][1], 0) for k in range(30)] + [clouds()[7]]
    got = topk_search.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=sizes[0], block_rows=sizes[1]).collect()
    whole = {(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v, _ in rows if sound(v)}
    want = []
    for q, v in whole:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:10])]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_topk_prunes_clusters_and_stays_exact(spark):
    """Far clusters of different sizes: shards and nodes that can't hold a better score are left out."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24)) * 10
    x = np.concatenate([c + rng.normal(size=(n, 24)) * 0.05 for c, n in zip(centres, rng.integers(20, 120, 30))]).astype(np.float32)
    rows = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    asks = F.col("vec_id") % 10 == 0
    got = topk_search.top_k(rows, asks, shard_rows=100, block_rows=50).collect()
    whole = np.floor(x.astype(float) * 1024).astype(np.int64)
    for q in range(0, len(x), 10):
        score = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:10]
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(-s, i) for s, i in best]
    cost = topk_search.search_cost(rows, asks, shard_rows=100, block_rows=50).first()
    pairs = len(x) * len(range(0, len(x), 10))
    assert cost.met < 0.5 * pairs and cost.compared < 0.3 * pairs


def test_topk_few_rows(spark):
    got = topk_search.top_k(table(spark, [(0, [1.0], 0), (1, [1.0], 0), (2, [1.0], 0)]), F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 1024 * 1024)]
    assert topk_search.top_k(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_cover_tree_covers():
    x = np.random.default_rng(0).normal(size=(300, 5))

    def check(node):
        d = np.sqrt(((x[node.rows] - node.centre) ** 2).sum(1))
        assert d.max() <= node.radius
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
            for c in node.children:
                check(c)

    check(topk_search.cover_tree(x))
