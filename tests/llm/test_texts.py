"""Quality, chat formatting, PII, SimHash, sharding, mixing, packing, WARC: odd input against brute force."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pointflux.llm import chat_format, mixing, packing, pii, quality, queries, sharding, simhash_dedup, warc
from pointflux.llm.common import components, new_path, word_count

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


# SimHash


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least.get(find(f)) for d, f in pairs}


def test_simhash_odd_rows(odd_docs, no_docs):
    got = simhash_dedup.simhash_components(odd_docs).collect()
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute_components([(d, brute_fingerprint(t)) for d, t in texts])
    assert Counter((r.doc_id, int(r.fingerprint, 16)) for r in got) == Counter((d, brute_fingerprint(t)) for d, t in texts)
    assert all(want[r.doc_id, int(r.fingerprint, 16)] == r.component_id for r in got)
    assert simhash_dedup.simhash_components(no_docs).count() == 0


@pytest.mark.parametrize("crowded", [256, 2])
def test_simhash_links_are_exact(spark, crowded):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 2**63, 200)}
    for f in list(fps)[:60]:
        for _ in range(4):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            fps.add(f ^ sum(1 << int(b) for b in bits))
    signed = [simhash_dedup._signed(f) for f in fps]
    edges = simhash_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowded)
    roots = {r.v: r.root for r in components(edges).collect()}
    want = brute_components([(i, f) for i, f in enumerate(sorted(fps))])
    groups = defaultdict(set)
    for (_, f), c in want.items():
        groups[c].add(f)
    for g in groups.values():
        assert len({roots.get(simhash_dedup._signed(f), simhash_dedup._signed(f)) for f in g}) == 1
    assert len({roots.get(s, s) for s in signed}) == len(groups)


def test_simhash_keeps_one_of_each(odd_docs):
    kept = simhash_dedup.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(None) == 1 and len(ids) == len(set(ids))


def brute_near(rows, least=0.8):
    """``{(doc_id, text): keeper}`` by comparing all pairs of five-word shingle sets; the keeper is a (doc_id, text)."""
    sets = {}
    for d, t in rows:
        w = words(t)
        k = min(5, len(w))
        sets[d, t] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    distinct = sorted(set(sets.values()), key=lambda s: (len(s), sorted(s)))
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if len(a) >= least * len(b) and len(a & b) >= least * len(a | b) - 1e-9:
                root[find(b)] = find(a)
    first = {}
    for d, t in sorted(sets, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(find(sets[d, t]), (d, t))
    return {x: first[find(s)] for x, s in sets.items()}


@pytest.mark.parametrize("part", [simhash_dedup.PART, 300])
def test_near_copies_against_brute_force(spark, part):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 5000)}"
    texts, passage = [], [word() for _ in range(40)]
    for n in (30, 60, 150, 400):
        for _ in range(3):
            base = [word() for _ in range(n)]
            for edits in (0, 0, 1, 1, 2, n // 40, n // 30, n // 10):
                copy = list(base)
                for at in rng.integers(0, n, edits):
                    copy[at] = word()
                texts.append(" ".join(copy))
    texts += [" ".join([*passage, *(word() for _ in range(60))]) for _ in range(30)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    got = simhash_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), part=part).collect()
    want = {d: c for (d, _), (c, _) in brute_near(rows).items()}
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert len(set(want.values())) > 45


def test_near_copies_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows += [(None, "no id here but twenty words " + "and more " * 4), (None, "no id here but twenty words " + "and more " * 4 + "x"), (None, "no id here")]
    docs = spark.createDataFrame([(*r, f"s{i}") for i, r in enumerate(rows)], "doc_id long, text string, _row string")
    want = brute_near(rows)
    kept = [(r.doc_id, r.text) for r in simhash_dedup.one_of_each(docs).collect()]
    groups = {k: {x for x in want if want[x] == k} for k in set(want.values())}
    assert len(kept) == len(groups) == len({want[r] for r in kept})
    for r in kept:  # the smallest id stays; without ids, one of the group does
        assert r[0] == want[r][0] and (r[0] is None or r == want[r] or sum(x[0] == r[0] for x in groups[want[r]]) > 1)
    assert simhash_dedup.near_copies(no_docs).count() == 0 and simhash_dedup.one_of_each(no_docs).count() == 0


def test_components_long_path_and_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (7, 6)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Sharding


def test_sharding_law(spark, odd_docs, no_docs):
    got = sharding.shard_documents(odd_docs, [1.0] * 24).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    facts = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert facts == {(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect()}
    assert sharding.shard_documents(no_docs, [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit("x"), [0.0])


def test_sharding_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 100)
    docs = spark.range(6_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, "x").alias("text"))
    out = sharding.shard_documents(docs, [1.0] * 4)
    rows = out.collect()
    assert len(rows) == 6_000 and sum(r.doc_id is None for r in rows) == 2_000
    for shard in range(4):
        slots = [(r.slot, r.doc_id, r.text_crc32, r.size) for r in rows if r.shard == shard]
        assert sorted(s for s, *_ in slots) == list(range(len(slots)))
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan  # numbering is done over rows counted once, and written


def brute_rendezvous(key, weights):
    """Shard by the definition, from XXH64 of the two strings one after the other, as Spark chains them."""
    draws = []
    for j, w in enumerate(weights):
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        h = xxhash.xxh64_intdigest(f"{sharding.SEED}:{j}".encode(), h)
        draws.append((-math.log(((h >> 11) + 0.5) / 2**53) / w, j))
    return min(draws)[1]


def test_sharding_against_brute_force(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    w = [1.0, 2.0, 0.5, 1.0]
    for r in sharding.shard_documents(docs, w).collect():
        assert (r.shard, r.grown_shard) == (brute_rendezvous(str(r.doc_id), w), brute_rendezvous(str(r.doc_id), [*w, 1.0]))


def test_sharding_follows_weights_and_moves_little(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    w = [1.0, 2.0, 1.0, 0.0]
    rows = keys.select(sharding.rendezvous(F.col("k"), w).alias("a"), sharding.rendezvous(F.col("k"), [*w, 1.0]).alias("b"))
    n = {r.a: r["count"] for r in rows.groupBy("a").count().collect()}
    assert 3 not in n and abs(n[1] / 20_000 - 0.5) < 0.02
    moved = rows.where("a != b")
    assert {r.b for r in moved.collect()} == {4} and abs(moved.count() / 20_000 - 0.2) < 0.02


# Chat formatting


def test_chat_round_trip(spark):
    trap = "\\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", trap), (1, 1, "assistant", trap), (1, 2, "assistant", "<|+|>\\n\\b"), (1, 3, "user", None), (2, None, "a: b", "x"), (2, 1, None, ""), (2, 1, None, ""),
        (None, 5, "assistant", "é\U0001f600"), (3, 0, "assistant", "\\" * 7 + "#" * 8 + "</turn></turn>\n"), (3, 1, "### user", "</tu</turn>rn>"), (4, 0, "user", "z" * 200_000),
    ]
    talk = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns int")
    out = chat_format.format_conversations(talk)
    read = out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert len(read) == len(want)
    for r in read:
        turns = [(x[2], x[3]) for x in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.t] == turns
        assert r.l == "".join(t for role, t in turns if role == "assistant")
    one = {r.conv_id: r.formatted for r in out.collect()}
    assert one[1].count("### ") == 3  # adjacent assistant turns share a block
    assert chat_format.format_conversations(talk.where("false")).count() == 0


def test_chat_is_native(spark):
    talk = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.format_conversations(talk)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# PII


def brute_spans(text):
    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    found = []
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for k, (kind, p) in enumerate(kinds):
        if kind == "email" and "@" not in (text or ""):
            continue  # Python's search is quadratic there
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15):
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


TRICKY = [
    "a@b.c_x@d.e", "a@b", "a@b.", "%%@x.y.z-", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "4111111111111111", "4111 1111-1111 1111 2", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "5", "5 5",
    "\x01a@b.co\x02 \x01", "4111\x014111", "é" * 50 + "x@y.zz" + "\U0001f600 10.0.0.1", "1." * 50_000, "1 " * 50_000, "a" * 100_000, "a@" + "b." * 20_000 + "c", "+" * 1000 + "1 234 567 890", "99999999999999999999.1.1.1",
    "Konto DE89 3704 0044 0532 0130 00 bank", "DE00 3704 0044 0532 0130 00", "serial GB82WEST12345698765432", None, "",
]


def test_pii_against_brute_force(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(TRICKY)], "doc_id long, text string, spans string, clean int")
    for r in pii.find_pii(docs).select("doc_id", "text", pii.listed(pii.base_only(F.col("spans"))).alias("base"), pii.listed(F.col("spans")).alias("all")).collect():
        assert r.base == ",".join(brute_spans(TRICKY[r.doc_id])), TRICKY[r.doc_id][:60]
        if r.doc_id == 22:
            assert r.all.startswith("iban:6:33") or ",iban:6:33" in r.all
        if r.doc_id == 23:
            assert "iban" not in r.all
    assert pii.find_pii(odd_docs).count() == odd_docs.count()
    assert pii.find_pii(no_docs).count() == 0


def test_pii_redaction_keeps_rows(odd_docs):
    out = pii.redact_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id}
    assert got[9] == "Mail [EMAIL] or [PHONE] now, [IP]" and got[4] is None and got[5] == "" and got[10].endswith("a [EMAIL]") is False
    assert got[10] == "é\U0001f600 [EMAIL]" and "[CARD]" in got[7] and got[7].endswith("tail ")


def test_ibans_end_where_their_country_says(spark):
    texts = ["BE71096123456769 BIC", "Konto BE71 0961 2345 6769 SWIFT 1", "AT611904300234573201 OK", "SE4550000000058398257466 NOW", "xBE71096123456769", "BE71096123456769A", "NO9386011117947"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in rows}
    assert got == {0: [(0, 16)], 1: [(6, 25)], 2: [(0, 20)], 3: [(0, 24)], 4: [], 5: [], 6: [(0, 15)]}


def test_context_moves_scores(spark):
    texts = ["10.0.0.1", "the server address 10.0.0.1", "version 10.0.0.1", "release 1.2.3.4 " + "x " * 60 + "host 1.2.3.4"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.scores(F.col("spans")).alias("s")).collect()
    assert {r.doc_id: r.s for r in rows} == {0: "0.60", 1: "0.80", 2: "0.40", 3: "0.40,0.80"}


def test_many_matches_and_turns_stay_near_linear(spark):
    def seconds(n):
        text = " ".join(f"a{i}@b.co or 10.0.0.{i % 256}" for i in range(n))
        turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begun = time.perf_counter()
        found = pii.find_pii(docs).select(pii.listed(F.col("spans")).alias("l"), pii.redact(F.col("text"), F.col("spans")).alias("r")).collect()[0]
        talk = chat_format.format_conversations(turns).select(chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()[0]
        took = time.perf_counter() - begun
        assert found.l == ",".join(brute_spans(text)) and found.r == " ".join(["[EMAIL] or [IP]"] * n)
        assert talk.l == "".join(f"t{i}" for i in range(1, n, 2))
        return took

    seconds(1_000)
    assert seconds(80_000) < 2.5 * seconds(40_000) + 1


# Quality


def test_quality_learns_and_scores_everything(spark, odd_docs, no_docs):
    rng = np.random.default_rng(1)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Word,"], 40))
    bad = lambda: " ".join(f"{w}$$$" for w in rng.choice(["alpha", "beta", "gamma"], 40))
    docs = spark.createDataFrame([(i, good() if i % 2 else bad()) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(None, 1), (3, None), (5, 9)], "doc_id long, quality int")
    model = quality.train(docs, labels, max_rows=200)
    got = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    assert np.mean([got[i].predicted == i % 2 for i in held]) > 0.98
    odd = quality.score_documents(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert len({r.score for r in odd if r.doc_id in (4, 5, 6)}) == 1
    assert quality.score_documents(no_docs, model).count() == 0
    assert quality.good_documents(docs, model).count() == sum(r.predicted for r in got.values())
    assert 0 < quality.train(docs, labels.where("false")).probability(1.0) < 1


# Mixing


def brute_targets(sizes, budget=1.5, most=2.0):
    """``{source: target}``: the level at which weighted shares, stopped at ``most`` sizes, add up, by bisection."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 2 * most * sum(sizes.values()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weight[s], most * sizes[s]) for s in order) < budget * sum(sizes.values()) else (low, mid)
    return {s: min(high * weight[s], most * sizes[s]) for s in order}


def brute_draws(rows):
    """How often each ``(source, u)`` is drawn: whole passes, a run from the start, then the largest that still fit."""
    sizes, units = Counter(), defaultdict(Counter)
    for s, size, u in rows:
        sizes[s] += size
        units[s][u] += size
    times = Counter()
    for s, target in brute_targets(sizes).items():
        full = min(2, int(target / sizes[s] + 1e-12)) if sizes[s] else 0
        left = max(0, int(target + 0.5) - full * sizes[s])
        order = sorted(units[s])
        for u in order:
            times[s, u] = full
        at = 0
        while at < len(order) and left > 0 and units[s][order[at]] <= left:
            times[s, order[at]] += 1
            left -= units[s][order[at]]
            at += 1
        for u in sorted(order[at:], key=lambda u: (-units[s][u], u)):
            if 0 < units[s][u] <= left:
                times[s, u] += 1
                left -= units[s][u]
    return times


def _mixable(spark, n=3000):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{min(int(rng.integers(0, 9)), 4)}" if i % 11 else None) for i in range(n)]
    rows += [(7_000_000, "a long one " * 400, "s1")] + [(8_000_000, "again and again", "s2")] * 400  # a hot row
    return rows, spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, source string, _mix string")


def test_mixing_against_brute_force(spark, odd_docs, no_docs):
    rows, docs = _mixable(spark)
    got = mixing.mix(docs).select("doc_id", "source", "_mix", mixing.order_key(F.col("doc_id"), F.col("text")).alias("u")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, taken = brute_targets(sizes), Counter()
    times = brute_draws([(r.source, r._mix.size, r.u) for r in got])
    assert len(got) == len(rows)
    for r in got:
        assert r._mix.source_size == sizes[r.source] and abs(r._mix.target - want[r.source]) < 1e-6 * want[r.source]
        assert len(r._mix.draws) == times[r.source, r.u] <= 2 or r._mix.size == 0
        assert all(0 <= d.shard < mixing.SHARDS for d in r._mix.draws)
        taken[r.source] += r._mix.size * len(r._mix.draws)
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)  # the smallest document left has at most three words
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).select("doc_id", "source", "_mix", mixing.order_key(F.col("doc_id"), F.col("text")).alias("u")).collect()))
    odd = mixing.mix(odd_docs.drop("_mix")).select("doc_id", "_mix").collect()
    assert len(odd) == odd_docs.count()
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_mixed_documents_spread_with_the_rows(spark, monkeypatch):
    rows, docs = _mixable(spark, 600)
    few = mixing.mixed_documents(docs)
    assert few.columns == docs.drop("_mix").columns
    monkeypatch.setattr(mixing, "PART_ROWS", 20)
    many = mixing.mixed_documents(docs)
    tasks = many.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(tasks) > 4 * mixing.SHARDS and few.rdd.getNumPartitions() == mixing.SHARDS
    assert Counter(map(tuple, few.collect())) == Counter(map(tuple, many.collect()))


def test_mixing_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1_000)  # plans are joined by shuffles
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int") + 1).alias("text"), F.format_string("h%06d", F.col("id") % 100_000).alias("source"))
    facts = mixing.mix(docs).select("source", "_mix.*")
    by = facts.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.size("draws")).alias("taken"), F.min("size").alias("least"))
    row = by.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("taken") > F.col("target") + 1).alias("over"), F.sum("target").alias("target"), F.sum("taken").alias("taken")).first()
    assert row.n == 100_000 and row.over == 0 and abs(row.target - 1.5 * docs.selectExpr("sum(doc_id % 7 + 1)").first()[0]) < 1 and 0.6 < row.taken / row.target <= 1


def test_splitting_tree_deals_every_block():
    quotas = np.array([0, 1, 7, 300, 512])
    dealt = mixing.split_quotas(quotas, 13)
    assert (dealt.sum(0) == quotas).all() and (dealt >= 0).all() and np.ptp(dealt.sum(1)) <= 4
    assert (dealt == mixing.split_quotas(quotas, 13)).all()


def test_splitting_tree_keeps_given_totals_and_large_quotas():
    quotas, totals = np.array([3, 50, 0, 90]), np.array([40, 3, 60, 40])
    dealt = mixing.split_quotas(quotas, 4, (7, 1), totals)
    assert (dealt.sum(0) == quotas).all() and (dealt.sum(1) == totals).all() and (dealt >= 0).all()
    large = np.array([10**12, 5, 3 * 10**11 + 7])
    dealt = mixing.split_quotas(large, 8)
    assert (dealt.sum(0) == large).all() and (dealt >= 0).all() and np.ptp(dealt.sum(1)) <= 3


def test_targets_share_the_excess(spark):
    def targets(sizes, weights, budget):
        rows = spark.createDataFrame([(f"s{i:03}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        return [r.target for r in mixing.with_targets(rows, weights, budget).orderBy("at").collect()]

    got = targets([10, 100, 100], [5, 2, 1], 200 / 210)
    assert got[0] == 20 and abs(sum(got) - 200) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    assert targets([1, 1], [1, 1], 50) == [2, 2] and targets([0, 5], [1, 1], 1) == [0, 5] and targets([], [1], 1) == []
    sizes = [3**i for i in range(12)]
    want = brute_targets({f"s{i:03}": s for i, s in enumerate(sizes)})
    assert np.allclose(targets(sizes, [5, 2, 1], 1.5), [want[f"s{i:03}"] for i in range(12)])


# Packing


def test_packing_loses_nothing(odd_docs, no_docs):
    got = packing.pack_documents(odd_docs, lengths=(8, 64, 4096)).collect()
    n = Counter()
    for r in got:
        n[r.doc_id] += r.words
    want = Counter()
    for r in odd_docs.collect():
        want[r.doc_id] += len(words(r.text))
    assert +want == n
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["at"]):
            assert r["at"] == at
            at += r.words
        assert at == rows[0].bin_used <= rows[0].bin_length and rows[0].bin_length == min(c for c in (8, 64, 4096) if c >= at)
    assert packing.pack_documents(no_docs).count() == 0


def test_best_fit_fills_the_tightest_bin():
    bins, at, length, used = packing.best_fit(np.array([900, 600, 124, 400, 24]), (512, 1024))
    assert bins[0] == bins[2] and bins[1] == bins[3] and bins[4] == bins[1] and used.tolist() == [1024, 1024] and length.tolist() == [1024, 1024]
    assert packing.best_fit(np.array([], int), (8,))[3].tolist() == []


def _total(sizes, lengths):
    return sum(map(packing.cost, packing.best_packing(np.array(sizes, np.int64), lengths)[2].tolist()))


def test_lengths_are_chosen_jointly():
    lengths = (512, 1024, 2048, 4096)
    opened = lambda sizes: sorted(packing.best_packing(np.array(sizes), lengths)[2].tolist())
    assert opened([1300] * 3) == [4096] and opened([1500, 548]) == [2048] and opened([1000]) == [1024] and opened([500, 12]) == [512]
    assert opened([3000, 1096, 1500, 500]) == [2048, 4096]
    rng = np.random.default_rng(4)
    # Uniform sizes are best served by the longest bins alone, so there the joint choice may only equal them.
    for strict, draw in enumerate((lambda n: rng.integers(1, 4097, n), lambda n: np.minimum(4096, rng.lognormal(5.5, 1.2, n).astype(int) + 1), lambda n: rng.choice([340, 513, 1300, 2600], n))):
        sizes = draw(3000)
        joint = _total(sizes, lengths)
        for one in lengths:  # always open that length, or the longest where it has no room
            singles = _total([s for s in sizes if s <= one], (one,)) + _total([s for s in sizes if s > one], (4096,))
            assert joint < singles or (not strict and joint == singles), (one, joint, singles)


def test_packing_cost_against_brute_force():
    lengths, rng = (8, 16, 32), np.random.default_rng(9)
    price = lambda n: packing.cost(min(c for c in lengths if c >= n))

    def least(sizes, bins=()):
        if not sizes:
            return sum(map(price, bins))
        ways = [bins[:i] + (b + sizes[0],) + bins[i + 1 :] for i, b in enumerate(bins) if b + sizes[0] <= 32] + [(*bins, sizes[0])]
        return min(least(sizes[1:], w) for w in ways)

    ratios = []
    for _ in range(60):
        sizes = rng.integers(1, 33, 7).tolist()
        ratios.append(_total(sizes, lengths) / least(tuple(sizes)))
    assert max(ratios) < 1.35 and np.mean(ratios) < 1.02


def test_packing_ties_repeats_and_utilisation(spark):
    docs = spark.createDataFrame([(None, "a b c d")] * 5 + [(1, "a b c d")] * 3 + [(2, "x " * 21)], "doc_id long, text string")
    packed = packing.pack_documents(docs, lengths=(8, 16))
    rows = packed.collect()
    assert Counter((r.doc_id, r.first_word, r.words) for r in rows) == Counter({(None, 0, 4): 5, (1, 0, 4): 3, (2, 0, 16): 1, (2, 16, 5): 1})
    facts = {r.bin_length: r for r in packing.utilisation(packed).collect()}
    assert sum(r.words for r in facts.values()) == 53 and all(0 < r.utilisation <= 1 for r in facts.values())
    assert sum(r.cost for r in facts.values()) == pytest.approx(sum(packing.cost(r.bin_length) for r in rows if r["at"] == 0))


def test_word_count(spark):
    texts = ["", " ", "a", " a  b\t\n", "a b c", None, "\x0b\x0ca\x1cb"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", word_count(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len(words(t)) for i, t in enumerate(texts)}


# WARC


def test_warc_round_trip(spark):
    rows = [(3, "u3", "same"), (1, "u1\r\nX: y", "same"), (2, None, "same"), (4, "u4", None), (5, "u5", ""), (6, "é", "é" * 9), (None, "n", "same"), (None, "m", "alone"), (7, "u", "x" * 300_000), (8, "u8", "solo")]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, address string, payload int")
    path = new_path(spark, "warc")
    warc.write_archive(pages, path)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    kinds = {}
    for r in got:
        if r.page_id is not None:
            kinds[r.page_id] = (r.record_type, r.refers_to)
        body = next(h or "" for p, _, h in rows if p == r.page_id and len((h or "").encode()) == r.payload_bytes).encode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        head, http, rest = bytes(r.record).split(b"\r\n\r\n", 2)
        assert head.startswith(b"WARC/1.1\r\n") and b"\r\nX: y" not in head
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert rest == (body if r.record_type == "response" else b"") + b"\r\n\r\n" and size == len(http) + 4 + len(rest) - 4
    assert kinds[1] == ("response", None) and kinds[2] == kinds[3] == ("revisit", 1) and kinds[5] == ("revisit", 4) and kinds[8] == ("response", None)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("address").distinct().count() == 6
    path = new_path(spark, "warc")
    warc.write_archive(pages.where("false"), path)
    assert warc.read_archive(spark, path).count() == 0
    path = new_path(spark, "warc")
    warc.write_archive(pages.where("page_id < 6"), path, min_bytes=5)
    assert {r.record_type for r in warc.read_archive(spark, path).collect()} == {"response"}


def test_warc_hot_payloads(spark, monkeypatch):
    rows = [(i, f"u{i}", f"p{i % 4}" if i % 2 else f"q{i}") for i in range(60)] + [(None, "n", "p1"), (1, "again", "p1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for hot in (1, 10_000):
        monkeypatch.setattr(warc, "HOT", hot)
        path = new_path(spark, "warc")
        warc.write_archive(pages, path)
        found.append(Counter((r.page_id, r.url, bytes(r.record)) for r in warc.read_archive(spark, path).collect()))
        assert spark.read.parquet(f"{path}/payloads").count() == 32
    assert found[0] == found[1] and sum(found[0].values()) == 62


def test_quality_counts_a_repeated_id_once(spark):
    docs = spark.createDataFrame([(2, "alpha beta")] * 50 + [(3, "gamma $$$")] + [(4, "alpha beta delta"), (6, "gamma $$$ $$$")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i < 4 else int(i == 6)) for i in (2, 3, 4, 6)] + [(2, 0), (99, 1)], "doc_id long, quality int")
    few = quality.train(docs.distinct(), labels.distinct().where("doc_id < 50"))
    many = quality.train(docs, labels, max_rows=4)  # a label of an absent document takes no place
    assert (few.weights == many.weights).all() and few.bias == many.bias
    assert quality.train(docs, labels, max_grams=1).weights.any() == False  # noqa: E712


def test_registered_queries_run_on_small_tables(spark):
    for name in ("op1_warc", "op4_chat_format", "op6_mixing", "op8_sharding", "op9_pii"):
        table = {"op1_warc": "pages", "op4_chat_format": "conversations"}.get(name, "documents")
        n = queries.QUERIES[name](spark, SF).count()
        whole = spark.read.parquet(f"{SF}/{table}.parquet")
        assert n == (whole.select("conv_id").distinct().count() + 1 if table == "conversations" else whole.count())
