"""Connected components of graphs given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, new_path, stage


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph ``edges(a, b)``.

    Returns ``(v, root)`` for every vertex on an edge; ``root`` is the smallest
    vertex of its component. Each round hooks every vertex to the neighbour, or
    itself, that a hash of the round puts first, jumps once and contracts the
    edges. As every round draws another order, a path loses a share of its
    vertices whatever its labels: rounds grow with the logarithm of the vertices.
    All steps are joins and partial aggregates; no component, label or edge list
    ever reaches the driver, and a vertex of any degree stays spread over tasks
    (minima are combined before the shuffle, join skew is split by adaptive
    execution). Loops, repeated edges and rows with a null end are ignored; no
    edges give no rows.
    """
    spark = edges.sparkSession
    at = [new_path(spark, "edges"), new_path(spark, "roots")]
    kept = stage(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "", at[0]
    )
    roots = stage(
        kept.select(F.col("a").alias("v")).union(kept.select("b")).distinct().withColumn("root", F.col("v")), "", at[1]
    )
    turn = 0
    while kept.limit(1).count():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("p"))  # noqa: B023, E731
        both = kept.union(kept.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("m")).select("v", F.least("m", rank("v"))["p"].alias("p"))
        hook_at = new_path(spark, "hook")
        hook = stage(hook, "", hook_at)
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jump_at = new_path(spark, "jump")
        jump = stage(hook.join(up, "p").select("v", F.col("pp").alias("p")), "", jump_at)
        ja, jb = jump.select(F.col("v").alias("a"), F.col("p").alias("pa")), jump.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        new = [new_path(spark, "edges"), new_path(spark, "roots")]
        kept = stage(
            kept.join(ja, "a").join(jb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "", new[0],
        )
        jr = jump.select(F.col("v").alias("root"), "p")
        roots = stage(roots.join(jr, "root", "left").select("v", F.coalesce("p", "root").alias("root")), "", new[1])
        for path in (*at, hook_at, jump_at):
            discard(spark, path)
        at = new
    least = roots.groupBy("root").agg(F.min("v").alias("least"))
    named = stage(roots.join(least, "root").select("v", F.col("least").alias("root")), "components")
    for path in at:
        discard(spark, path)
    return named
