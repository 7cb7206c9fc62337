"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for every key; the key goes to the shard with the
lowest draw, scaled by the shard's weight. Adding a shard adds one draw per key,
so the only rows that move are those the new shard wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SEED = "rendezvous-1"
#: Rows that one task numbers at a time, about.
ROWS_PER_RUN = 200_000
#: Rows alike that one task writes out at a time, about.
CHUNK = 10_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of ``key`` (a string; null counts as one key of its own) over ``len(weights)`` shards.

    Shard j's draw is -ln(u) / weight with u in (0, 1) from a hash of key and j;
    the smallest draw wins, which gives every shard its weight's share of keys.
    A weight of 0 closes a shard; ties, one in 2**53, go to the lower shard.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights need one positive number at least and no negative one")
    draws = []
    for j, w in enumerate(weights):
        if w:
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{SEED}:{j}")), 11).cast("double") + 0.5) / float(1 << 53)
            draws.append(F.struct((-F.ln(u) / float(w)).alias("draw"), F.lit(j).alias("shard")))
    return F.array_min(F.array(*draws))["shard"] if len(draws) > 1 else draws[0]["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float], doc_id: str = "doc_id", text: str = "text", grow_by: float | None = 1.0) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, grown_shard)`` for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8, ``text_crc32`` the
    unsigned CRC-32 of those bytes. doc_id and the number and weights of shards
    alone decide ``shard``, so rows that repeat a doc_id stay together, rows
    without one too. ``grown_shard`` is the shard once one more of weight
    ``grow_by`` is open (null: not asked for). ``slot`` numbers the rows of a
    shard from 0 without gaps by (run, doc_id, CRC, size); rows alike in all of
    these are interchangeable. Other columns are ignored; an empty table gives no rows.

    Numbering needs no task per shard: rows fall into runs by a hash of their
    content, each run is numbered alone and starts where the runs before it end.
    Rows alike are counted before any shuffle and numbered as one range, which is
    spread again in chunks, so a shard, key or row that holds a third of all rows
    gathers in no task.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.col(doc_id).cast("string")
    grown = F.lit(None).cast("int") if grow_by is None else rendezvous(F.col("key"), [*weights, grow_by])
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), key.alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32")
    ).select("doc_id", "size", "text_crc32", rendezvous(F.col("key"), weights).alias("shard"), grown.alias("grown_shard"))
    rows = stage(rows.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard").agg(F.count(F.lit(1)).alias("copies")), "sharded")
    runs = max(1, -(-rows.count() // ROWS_PER_RUN)) * 8
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(runs)).cast("int"))
    counts = rows.groupBy("shard", "run").agg(F.sum("copies").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "run", F.coalesce(before, F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "run").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("at", F.coalesce(F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = numbered.join(F.broadcast(starts), ["shard", "run"]).withColumn("first", F.col("start") + F.col("at")).drop("start", "at", "run")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK))).alias("chunk")
    numbered = stage(numbered, "numbered")
    few = numbered.where(F.col("copies") <= CHUNK).withColumn("chunk", F.lit(0).cast("long"))
    many = numbered.where(F.col("copies") > CHUNK).select("*", chunk).repartition("doc_id", "text_crc32", "chunk")
    begin = F.col("first") + F.col("chunk") * CHUNK
    end = F.least(begin + CHUNK, F.col("first") + F.col("copies")) - 1
    return few.unionByName(many).select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(begin, end)).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], doc_id: str = "doc_id") -> None:
    """Write ``docs`` below ``path``, one folder ``_shard=j`` per shard.

    Rows go straight from the tasks that read them to the folders, without a
    shuffle, so a shard of any size is written by many tasks.
    """
    docs.withColumn("_shard", rendezvous(F.col(doc_id).cast("string"), weights)).write.partitionBy("_shard").parquet(path)
