"""Mixing sources to target weights by a splitting tree of block quotas.

A source's documents fall into blocks by a hash, which also permutes them. A
pass over a source takes whole blocks in order; the last, partial pass ends
before the document that no longer fits, and what is left is filled with the
largest documents after it that still do. The blocks that all sources give are
dealt over output shards by a binary tree: at each node the quotas of the left
half are one multivariate hypergeometric draw, so every shard gets an exact
number of blocks of every source and the shards together get all. A shard takes
its blocks as a run of the source's permuted blocks, disjoint from every
other's, and is shuffled locally.

The plan is a table with one row for each source, made by joins and grouped
aggregates however many sources there are; the driver sees a few totals and the
quotas of QUOTA_GROUPS groups of sources. Documents look themselves up in the
plan, so texts are not shuffled for it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.layout import dense_ids
from .common import stage, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
BLOCK_BITS = 8
LEVELS = 3
WIDE = BLOCK_BITS * LEVELS + 32
SHARDS = 16
SEED = 20_250_101
#: The splitting tree deals blocks over shards for so many groups of sources at once, then group by group.
QUOTA_GROUPS = 1_024
#: A table of so many rows at most is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Words and rows that one task of a mixed result holds, about.
PART_WORDS, PART_ROWS = 4_000_000, 50_000
#: From so many blocks on, a node of the tree draws by systematic rounding instead.
MANY_BLOCKS = 1_000_000_000


def split_quotas(quotas: np.ndarray, shards: int, seed: object = SEED, totals: np.ndarray | None = None) -> np.ndarray:
    """Deal ``quotas[source]`` blocks over ``shards``: an array [shard, source] that sums to them.

    Each node of a binary tree over the shards draws the left half's share of
    every source at once, multivariate hypergeometric over all blocks of the
    node, so shards get as many blocks in total as whole blocks allow, or
    ``totals[shard]``, where given.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def deal(q: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = q
            return
        mid = (low + high) // 2
        total = int(q.sum())
        share = total * (mid - low) // (high - low) if totals is None else int(totals[low:mid].sum())
        left = _draw(q, share, total, np.random.default_rng([*np.atleast_1d(seed), low, high]))
        deal(left, low, mid)
        deal(q - left, mid, high)

    deal(quotas.astype(np.int64), 0, shards)
    return out


def _draw(q: np.ndarray, share: int, total: int, rng: np.random.Generator) -> np.ndarray:
    """``share`` of ``total`` blocks, by source."""
    if not total:
        return q * 0
    if total < MANY_BLOCKS:
        return rng.multivariate_hypergeometric(q, share, method="marginals")
    shift = int(rng.integers(total))
    ends = [(int(u) * share + shift) // total for u in [0, *np.cumsum(q)]]
    return np.diff(np.array(ends, np.int64))


def _small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, a staged one, to be broadcast if it has ``most`` rows or fewer."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def order_key(doc_id: Column, text: Column) -> Column:
    """The hash in [0, 2**WIDE) that orders a source's documents."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), doc_id, text), 64 - WIDE)


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(source).cast("string").alias("source"), word_count(body).alias("size"), order_key(F.col(doc_id), body).alias("u"))


def with_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``totals(source, source_size)`` with ``at``, the source's number by code point, null last, and ``target``.

    Sources share ``budget`` times all words by weight, the weights repeating in
    that order; a target stops at ``most`` times its source's size and the excess
    is shared anew among the others by weight, until none is above.
    """
    rows = stage(dense_ids(totals, [F.col("source").asc_nulls_last()], "at").withColumn("kind", (F.col("at") % len(weights)).cast("int")), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1)
    whole = rows.agg(F.sum("source_size")).first()[0] or 0
    capped, scale = -1, 0.0
    while True:
        full = (scale * weight > most * F.col("source_size")) if capped >= 0 else F.lit(False)
        sums = {r["kind"]: r for r in rows.groupBy("kind").agg(F.count_if(~full).alias("free"), F.count_if(full).alias("full"), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("words")).collect()}  # a row for each weight
        now = sum(r["full"] for r in sums.values())
        free = sum(float(weights[k]) * r["free"] for k, r in sums.items())
        if now == capped or not free:
            break
        capped, scale = now, max(0.0, budget * whole - most * sum(r["words"] for r in sums.values())) / free
    share = F.lit(scale) * weight
    target = F.least(share, most * F.col("source_size")) if free else most * F.col("source_size").cast("double")
    return rows.select("at", "source", "source_size", target.cast("double").alias("target"))


def _of_source(sized: DataFrame, table: DataFrame, where: Column | None = None) -> DataFrame:
    """Documents joined with ``table`` on their source, null as a source of its own."""
    match = sized["source"].eqNullSafe(table["source"])
    return sized.join(_small(table), match if where is None else match & where).drop(table["source"])


def _until(sized: DataFrame, need: DataFrame) -> DataFrame:
    """Where each source's partial pass ends: ``need(at, source, left)`` with ``until`` and what is ``left`` then.

    The pass takes the documents with ``u < until``; the next one's words are more
    than ``left``. Three histograms of 256 blocks narrow the place, then documents.
    """
    block = lambda level: F.shiftright("u", WIDE - BLOCK_BITS * level)
    state = need.withColumn("prefix", F.lit(0).cast("long"))
    ended = []
    by = Window.partitionBy("at")
    for level in range(1, LEVELS + 2):
        place = block(level) if level <= LEVELS else F.col("u")
        inside = _of_source(sized, state, block(level - 1) == F.col("prefix")) if level > 1 else _of_source(sized, state)
        steps = inside.groupBy("at", "left", place.alias("b")).agg(F.sum("size").alias("words"))
        steps = steps.withColumn("upto", F.sum("words").over(by.orderBy("b")))
        cut = steps.where("upto > left").groupBy("at").agg(F.min(F.struct("b", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
        after = stage(state.join(cut, "at", "left"), "cuts")
        # A source that is needed whole has no place where it ends.
        if level == 1:
            ended.append(after.where("cut is null").select("at", "source", "left", F.lit(1 << WIDE).alias("until")))
        state = after.where("cut is not null").select("at", "source", (F.col("left") - F.col("cut.before")).alias("left"), F.col("cut.b").alias("prefix"))
    return stage(ended[0].unionByName(state.withColumnRenamed("prefix", "until")), "until")


def _fillers(sized: DataFrame, ends: DataFrame) -> DataFrame:
    """``(at, source, fill)``: documents after the end of the partial pass that fill what is left.

    The largest that still fits is taken, and again, over all sizes; of equal ones
    those first in order. So less than the smallest document left stays open.
    Documents alike in id and text are one unit, taken together or not.
    """
    open_ends = ends.where("left > 0").withColumnRenamed("source", "of")
    match = sized["source"].eqNullSafe(open_ends["of"]) & (F.col("u") > F.col("until")) & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
    after = sized.join(_small(open_ends), match)
    units = stage(after.groupBy("at", "left", "u").agg(F.sum("size").alias("size")).where("size <= left"), "units")
    sizes = units.groupBy("at", "left", "size").agg(F.count(F.lit(1)).alias("n"))
    # At most ``left`` distinct sizes a source, and ``left`` is less than the document that did not fit.
    listed = sizes.groupBy("at", "left").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    none = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<size:bigint,n:bigint>>").alias("takes"))

    def step(acc: Column, s: Column) -> Column:
        n = F.least(s["n"], F.floor(acc["left"] / s["size"]))
        take = F.when(n > 0, F.concat(acc["takes"], F.array(F.struct(s["size"].alias("size"), n.alias("n"))))).otherwise(acc["takes"])
        return F.struct((acc["left"] - n * s["size"]).alias("left"), take.alias("takes"))

    takes = listed.select("at", F.explode(F.aggregate("sizes", none, step, lambda acc: acc["takes"])).alias("t")).select("at", "t.size", F.col("t.n").alias("wanted"))
    takes = stage(takes, "takes")
    most = takes.agg(F.max("wanted")).first()[0]
    if not most:
        return sized.sparkSession.createDataFrame([], "at long, u long")
    first = F.row_number().over(Window.partitionBy("at", "size").orderBy("u"))
    return units.join(_small(takes), ["at", "size"]).withColumn("k", first).where(F.col("k") <= most).where("k <= wanted").select("at", "u")


def _cuts(quotas: DataFrame, shards: int) -> DataFrame:
    """``(at, cuts)`` of ``quotas(at, quota)``: each shard's end in the source's sequence of blocks."""
    group = F.pmod(F.xxhash64("at"), F.lit(QUOTA_GROUPS)).cast("int")
    grouped = quotas.withColumn("g", group)
    sums = {r["g"]: r["n"] for r in grouped.groupBy("g").agg(F.sum("quota").alias("n")).collect()}  # QUOTA_GROUPS rows at most
    names = sorted(sums)
    dealt = split_quotas(np.array([sums[g] for g in names], np.int64), shards)
    totals = {g: dealt[:, i].tolist() for i, g in enumerate(names)}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        cuts = split_quotas(pdf["quota"].to_numpy(), shards, (SEED, key[0]), np.array(totals[key[0]])).cumsum(0).T
        return pd.DataFrame({"at": pdf["at"].to_numpy(), "cuts": list(cuts)})

    return grouped.groupBy("g").applyInPandas(run, "at long, cuts array<long>")


def plan_mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The plan of a mix of ``sized(source, size, u)``: a row for each source, and the documents that fill up.

    ``source, source_size, target, full, until, cuts``: the partial pass, after
    ``full`` whole ones, takes the documents with ``u < until`` and those in the
    second table, ``(source, u)``; ``cuts`` are the shards' bounds in the source's
    sequence of blocks.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = with_targets(totals, weights, budget, most)
    full = F.when(F.col("source_size") > 0, F.least(F.lit(int(most)), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    left = F.greatest(F.lit(0), F.round("target").cast("long") - F.col("full") * F.col("source_size"))
    rows = stage(rows.withColumn("full", full).withColumn("left", left), "targets")
    ends = _until(sized, rows.where("left > 0").select("at", "source", "left"))
    fill = stage(_fillers(sized, ends).join(rows.select("at", "source"), "at").select("at", "source", "u"), "fill")
    blocks = 1 << BLOCK_BITS
    last = F.when(F.col("until") > 0, F.shiftright(F.col("until") - 1, WIDE - BLOCK_BITS) + 1).when(F.col("filled"), 1).otherwise(0)
    rows = rows.drop("left").join(ends.select("at", "until"), "at", "left").join(fill.select("at").distinct().withColumn("filled", F.lit(True)), "at", "left")
    rows = stage(rows.withColumn("until", F.coalesce("until", F.lit(0).cast("long"))).withColumn("quota", (F.col("full") * blocks + F.least(F.lit(blocks), last)).cast("long")), "ends")
    plan = rows.join(_cuts(rows.select("at", "quota"), shards), "at").select("source", "source_size", "target", "full", "until", "cuts")
    return stage(plan, "plan"), fill.select("source", "u")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with what the mix does with each row.

    Adds ``_mix``, a struct of ``size``, ``source_size``, ``target`` and
    ``draws``, an array of (shard, order): the row goes once into each named
    output shard and stands there by ``order``; no draw, no place. Size is a
    text's number of words (null: 0). Sources weigh 5, 2, 1 in turn by code
    point, null last, and share ``budget`` times all words; no target exceeds
    ``most`` times its source, the excess is shared anew by weight. A source
    gives its target but for less than the smallest document left; no document
    is drawn more than ``most`` times. Rows alike in id and text are drawn alike.
    Texts without words are drawn with their block. Reruns agree. A column named
    ``_mix`` is replaced; an empty table gives no rows.
    """
    return _mix(docs, stage(_sized(docs, doc_id, text, source), "sizes"), weights, budget, most, shards, doc_id, text, source)


def _mix(docs: DataFrame, sized: DataFrame, weights: Sequence[float], budget: float, most: float, shards: int, doc_id: str, text: str, source: str) -> DataFrame:
    plan, fill = plan_mix(sized, weights, budget, most, shards)
    body, own = F.col(text).cast("string"), F.col(source).cast("string")
    kept = [c for c in docs.columns if c != "_mix"]
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("_row"), word_count(body).alias("_size"), order_key(F.col(doc_id), body).alias("_u"), own.alias("_source"))
    rows = rows.join(_small(plan), F.col("_source").eqNullSafe(F.col("source")), "left").drop("source")
    fill = fill.select(F.col("source").alias("_of"), F.col("u").alias("_at"), F.lit(True).alias("_fills")).distinct()
    rows = rows.join(_small(fill), F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_u") == F.col("_at")), "left")
    block = F.shiftright("_u", WIDE - BLOCK_BITS)

    def draw(p: int) -> Column:
        at = F.least(F.lit(p << BLOCK_BITS) + block, F.element_at("cuts", -1) - 1)  # what fills up counts with the last block
        shard = F.least(F.size(F.filter("cuts", lambda c: c <= at)), F.lit(shards - 1))
        return F.struct(shard.alias("shard"), F.xxhash64(F.lit(SEED + 1 + p), "_u").alias("order"))

    takes = lambda p: (F.col("full") > p) | ((F.col("full") == p) & ((F.col("_u") < F.col("until")) | F.coalesce("_fills", F.lit(False))))
    passes = F.array(*[F.when(takes(p), draw(p)) for p in range(int(most))])
    facts = F.struct(F.col("_size").alias("size"), "source_size", "target", F.filter(passes, lambda x: x.isNotNull()).alias("draws"))
    return rows.select("_row.*", facts.alias("_mix"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows that the mix takes, each as often as it is drawn, with the columns of ``docs``.

    Rows are dealt by output shard and shuffled inside it. A shard is spread over
    as many tasks as its share of the words and rows asks for, so tasks grow with
    the data and no shard's size bounds one.
    """
    sized = stage(_sized(docs, doc_id, text, source), "sizes")
    whole = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    parts = int(max(1, -(-budget * whole["words"] // (shards * PART_WORDS)), -(-most * whole["n"] // (shards * PART_ROWS))))
    rows = _mix(docs, sized, weights, budget, most, shards, doc_id, text, source)
    drawn = rows.select("*", F.explode("_mix.draws").alias("_draw"))
    place = F.col("_draw.shard") * parts + F.pmod(F.col("_draw.order"), F.lit(parts)).cast("int")
    dealt = drawn.repartitionById(shards * parts, place).sortWithinPartitions("_draw.shard", "_draw.order")
    return dealt.select(*[c for c in docs.columns if c != "_mix"])
