"""Adapters that give the driver's tables the shapes the operators work on.

Each adapter exists twice: as a DataFrame and, under the same name, as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A point per order: position, lifetime, logit, edits.
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double")
    return read(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 4).cast("int").alias("segment_id"),
        F.col("o_orderkey").alias("stable_id"),
        (F.col("o_totalprice") / 1000.0).alias("x"),
        F.col("o_custkey").cast("double").alias("y"),
        day.alias("z"),
        (day % 30).alias("mu"),
        ((F.col("o_custkey") % 7) + 0.5).cast("double").alias("w"),
        ((F.col("o_orderkey") % 21) - 10).cast("double").alias("opacity"),
        (F.col("o_orderstatus") == "F").alias("deleted"),
        (F.col("o_orderpriority") == "1-URGENT").alias("selected"),
    )


#: A track per order with a key per line number, ten frames apart.
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track"), F.col("l_linenumber").cast("int").alias("k"))
    rows = lines.agg(F.min("l_quantity").alias("x"), F.min("l_discount").alias("d"), F.min("l_tax").alias("t"), F.min("l_extendedprice").alias("p"))
    return rows.select(
        "track", "k", ((F.col("k") - 1) * 10).cast("int").alias("frame"), "x",
        F.round(F.col("d") * 100).alias("y"), F.round(F.col("t") * 100).alias("z"),
        F.floor(F.col("p")).cast("long").alias("v"), (F.floor(F.col("p")).cast("long") % 65536).cast("int").alias("v16"),
    )


#: A track per user: values over hours.
def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352.0).alias("frame"),
        "value", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("code"), "event_type", "event_id",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("e"))


SQL = {
    "points": """points AS (SELECT CAST(o_orderkey % 4 AS INTEGER) AS segment_id, o_orderkey AS stable_id,
        o_totalprice / 1000.0::DOUBLE AS x, CAST(o_custkey AS DOUBLE) AS y,
        CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS z,
        CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) % 30 AS DOUBLE) AS mu,
        CAST((o_custkey % 7) + 0.5 AS DOUBLE) AS w, CAST((o_orderkey % 21) - 10 AS DOUBLE) AS opacity,
        o_orderstatus = 'F' AS deleted, o_orderpriority = '1-URGENT' AS selected FROM orders)""",
    "keys": """keys AS (SELECT l_orderkey AS track, CAST(l_linenumber AS INTEGER) AS k, CAST((l_linenumber - 1) * 10 AS INTEGER) AS frame,
        min(l_quantity) AS x, round(min(l_discount) * 100) AS y, round(min(l_tax) * 100) AS z,
        CAST(floor(min(l_extendedprice)) AS BIGINT) AS v, CAST(CAST(floor(min(l_extendedprice)) AS BIGINT) % 65536 AS INTEGER) AS v16
        FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "signal": """signal AS (SELECT user_id AS track, epoch_us(ts) / 3.6e9::DOUBLE - 473352.0::DOUBLE AS frame, value,
        CAST(floor(value * 100 + 0.5) AS BIGINT) AS code, event_type, event_id FROM events)""",
    "vectors": "vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
}


def with_views(names: str, body: str) -> str:
    """``body`` after the named adapters; one that begins with MORE, or MORE RECURSIVE, goes on with expressions of its own."""
    views, body = ", ".join(SQL[n] for n in names.split()), body.lstrip()
    for start, word in (("MORE RECURSIVE", "WITH RECURSIVE"), ("MORE", "WITH")):
        if body.startswith(start):
            return f"{word} {views}, {body[len(start) :]}"
    return f"WITH {views} {body}"


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL over the named adapters.

    SQL that begins with MORE adds common table expressions of its own.
    """

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = with_views(views, sql) if views else sql
        return fn

    return add
