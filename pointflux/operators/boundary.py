"""Identity across clips: exact and approximate matching of boundary points, track and slot maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q


def exact_match(previous: DataFrame, current: DataFrame, key: Sequence[str], features: str = "features", weights: Sequence[int] | None = None) -> DataFrame:
    """Pair points whose key is equal in all parts: ``(cur, prev, candidates)``.

    ``previous(prev, key..., features array<int>)`` and ``current(cur, ...)``. Keys
    that occur once on each side are a plain equi-join. Points of a repeated key
    are paired in current order, each with the free candidate of the highest
    score, the number of equal features by weight; the first best in candidate
    order wins, and a taken candidate's place is filled by the list's last. That
    choice depends on the ones before it, so such a key is handled as a whole.
    """
    counted = lambda df: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    pn, cn = counted(previous).withColumnRenamed("n", "pn"), counted(current).withColumnRenamed("n", "cn")
    sizes = pn.join(cn, list(key))
    single = sizes.where("pn = 1 and cn = 1").select(*key)
    plain = current.join(single, list(key)).join(previous.drop(features), list(key)).select("cur", "prev", F.lit(1).alias("candidates"))
    many = sizes.where("pn > 1 or cn > 1").select(*key)
    lists = previous.join(many, list(key)).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("prev", features))).alias("_p"))
    lists = lists.join(current.join(many, list(key)).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("cur", features))).alias("_c")), list(key))
    kinds = {**{f.name: f.dataType.simpleString() for f in previous.schema.fields}, **{f.name: f.dataType.simpleString() for f in current.schema.fields}}
    w = list(weights) if weights else None

    def pair(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            out = []
            for ps, cs in zip(pdf["_p"], pdf["_c"], strict=True):
                free = list(ps)
                for c in cs:
                    if not free:
                        break
                    scores = [sum((w[i] if w else 1) for i, (a, b) in enumerate(zip(p[features], c[features], strict=True)) if a == b) for p in free]
                    at = scores.index(max(scores))
                    out.append((c["cur"], free[at]["prev"], len(ps)))
                    free[at] = free[-1]
                    free.pop()
            yield pd.DataFrame(out, columns=["cur", "prev", "candidates"])

    return plain.union(lists.select("_p", "_c").mapInPandas(pair, f"cur {kinds['cur']}, prev {kinds['prev']}, candidates int"))


def near_match(previous: DataFrame, current: DataFrame, axes: Sequence[str], limit: float, gate: Column | None = None) -> DataFrame:
    """Pair points within ``limit`` one to one: ``(cur, prev, d2)``.

    Both sides have ``axes`` (the current side's columns prefixed ``c_``). Space is
    cut into cells of the limit's width and a current point meets the previous
    points of its own and neighbouring cells by an equi-join. Each current point
    proposes its nearest (ties: the later one), then the gate may reject it, then
    each previous point takes its nearest proposer.
    """
    cell = lambda c: F.floor(F.col(c) / limit)
    prev = previous.select("prev", *axes, *[c for c in previous.columns if c not in ("prev", *axes)], F.struct(*[cell(a).alias(a) for a in axes]).alias("_cell"))
    around = F.array(*[F.struct(*[(cell(f"c_{a}") + d).alias(a) for a, d in zip(axes, step)]) for step in product((-1, 0, 1), repeat=len(axes))])
    cur = current.withColumn("_cell", F.explode(around))
    d2 = sum(((F.col(a) - F.col(f"c_{a}")) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.col(f"c_{axes[0]}")) ** 2)
    met = cur.join(prev, "_cell").withColumn("d2", d2).where(F.col("d2") <= limit * limit)
    rest = [c for c in met.columns if c not in ("cur", "_cell")]
    best = met.groupBy("cur").agg(F.min_by(F.struct(*rest), F.struct("d2", -F.col("prev"))).alias("b")).select("cur", "b.*")
    if gate is not None:
        best = best.where(gate)
    return best.groupBy("prev").agg(F.min(F.struct("d2", "cur")).alias("b")).select("b.cur", "prev", "b.d2")


def extend_tracks(current: DataFrame, matches: DataFrame, known: DataFrame, next_id: int, local: str = "cur") -> DataFrame:
    """``(cur, track_id)``: matched points inherit, the others get new ids in local order; none is recycled.

    New ids are numbered bucket by bucket, so a large clip needs no single task.
    """
    from .layout import dense_ids

    inherited = matches.join(known, "prev").select(local, "track_id")
    fresh = current.select(local).join(inherited.select(local), local, "left_anti")
    numbered = dense_ids(fresh, [local], "_i")
    return inherited.union(numbered.select(local, (F.col("_i") + next_id).alias("track_id")))


def recycle_slots(unmatched: DataFrame, free: DataFrame, next_slot: int, local: str = "cur") -> DataFrame:
    """``(cur, slot)``: the i-th unmatched point gets the i-th free slot, then new ones."""
    from .layout import dense_ids

    points = dense_ids(unmatched.select(local), [local], "_i")
    slots = dense_ids(free.select("slot"), ["slot"], "_i")
    have = slots.agg(F.count(F.lit(1)).alias("_f"))
    new = F.lit(next_slot) + F.col("_i") - F.col("_f")
    return points.join(slots, "_i", "left").crossJoin(F.broadcast(have)).select(local, F.coalesce("slot", new).alias("slot"))


def presence(map_rows: DataFrame, segments: Sequence[int]) -> DataFrame:
    """``(track_id, in_<segment>...)``: each segment's local id of a track, null where it is absent."""
    return map_rows.groupBy("track_id").agg(*[F.max(F.when(F.col("segment_id") == s, F.col("local"))).alias(f"in_{s}") for s in segments])


def near_surface(queries: DataFrame, samples: DataFrame, axes: Sequence[str], limit: float, key: str) -> DataFrame:
    """Query points with a sample within ``limit``; a cell equi-join, each query once."""
    cell = lambda c: F.floor(F.col(c) / limit)
    held = samples.select(*[F.col(a).alias(f"s_{a}") for a in axes], F.struct(*[cell(a).alias(a) for a in axes]).alias("_cell"))
    around = F.array(*[F.struct(*[(cell(a) + d).alias(a) for a, d in zip(axes, step)]) for step in product((-1, 0, 1), repeat=len(axes))])
    asked = queries.withColumn("_cell", F.explode(around))
    d2 = sum(((F.col(a) - F.col(f"s_{a}")) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.col(f"s_{axes[0]}")) ** 2)
    return asked.join(held, (asked["_cell"] == held["_cell"]) & (d2 <= limit * limit), "left_semi").drop("_cell").dropDuplicates([key])


def last_keys(keys: DataFrame, track: str, order: str, columns: Sequence[str]) -> DataFrame:
    return keys.groupBy(track).agg(F.max_by(F.struct(*columns), order).alias("_l")).select(track, "_l.*")


def rank_in(partition: Sequence[str], order: Sequence[Column | str]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def ellipsoids(points: DataFrame, sigmas: float, *keep: str) -> DataFrame:
    """Rotated ellipsoids ``(stable_id, x, y, z, s0..s2, qw..qz)`` with their rotation ``r00..r22`` and half extents ``hx, hy, hz`` at so many sigmas."""
    rows = points.withColumn("_q", Q.normalize(Q.quat(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])))
    w, x, y, z = (F.col(f"_q.{c}") for c in "wxyz")
    turn = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]
    size = [F.greatest(F.col(f"s{i}").cast("double"), F.lit(1e-7)) for i in range(3)]
    rows = rows.select("stable_id", "x", "y", "z", *keep, *[size[i].alias(f"s{i}") for i in range(3)], *[turn[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)])
    reach = [sigmas * F.sqrt(sum(((F.col(f"r{i}{j}") * F.col(f"s{j}")) ** 2 for j in (1, 2)), (F.col(f"r{i}0") * F.col("s0")) ** 2)) for i in range(3)]
    return rows.withColumns({f"h{a}": reach[i] for i, a in enumerate("xyz")})


def brick_overlaps(points: DataFrame, brick: float, sigmas: float = 3.5) -> DataFrame:
    """``(stable_id, bx, by, bz)``: the bricks that a rotated ellipsoid of so many sigmas may touch.

    ``points(stable_id, x, y, z, s0, s1, s2, qw, qx, qy, qz)``. Bricks of the
    ellipsoid's bounding box are kept if their box, seen from the ellipsoid's own
    axes in sigmas, comes within ``sigmas`` of its centre; none that it touches is lost.
    """
    rows = ellipsoids(points, sigmas)
    edge = lambda a, sign: F.floor((F.col(a) + sign * F.col(f"h{a}")) / brick)
    for a in "xyz":
        rows = rows.withColumn(f"b{a}", F.explode(F.sequence(edge(a, -1), edge(a, 1))))
    delta = [(F.col(f"b{a}") + 0.5) * brick - F.col(a) for a in "xyz"]
    outside = []
    for j in range(3):
        local = sum((delta[i] * F.col(f"r{i}{j}") for i in (1, 2)), delta[0] * F.col(f"r0{j}")) / F.col(f"s{j}")
        half = brick / 2 * sum((F.abs(F.col(f"r{i}{j}")) for i in (1, 2)), F.abs(F.col(f"r0{j}"))) / F.col(f"s{j}")
        outside.append(F.greatest(F.lit(0.0), F.abs(local) - half))
    near = outside[0] ** 2 + outside[1] ** 2 + outside[2] ** 2 <= sigmas * sigmas
    return rows.where(near).select("stable_id", "bx", "by", "bz")


def nearest_in_view(faces: DataFrame, bodies: DataFrame, axes: Sequence[str], limit: float, group: str, rank: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``(face, body, distance)``: each face's nearest body of its group within ``limit``, the smaller id of equals.

    Space is cut into cells of the limit's width; a face meets the bodies of its own
    and the neighbouring cells of its group, so a group of any size forms no pairs
    beyond those. ``rank(distance, body)``, where given, says which body within
    ``limit`` comes first (the smaller id of equals); ``distance`` is the least one
    whatever the rank.
    """
    cell = lambda a: F.floor(F.col(a) / limit)
    around = faces.select("face", group, *[F.col(a).alias(f"f{a}") for a in axes], *[cell(a).alias(f"c{a}") for a in axes])
    for a in axes:
        around = around.withColumn(f"c{a}", F.explode(F.array(*[F.col(f"c{a}") + d for d in (-1, 0, 1)])))
    placed = bodies.select("body", group, *axes, *[cell(a).alias(f"c{a}") for a in axes])
    met = around.join(placed, [group, *[f"c{a}" for a in axes]])
    off = [F.col(f"f{a}") - F.col(a) for a in axes]
    distance = F.abs(off[0]) if len(off) == 1 else F.sqrt(sum((o**2 for o in off[1:]), off[0] ** 2))
    first = (rank(F.col("d"), F.col("body")) if rank else F.col("d")).alias("rank")
    best = met.withColumn("d", distance).where(F.col("d") <= limit).groupBy("face").agg(F.min(F.struct(first, "body")).alias("b"), F.min("d").alias("distance"))
    return best.select("face", F.col("b.body").alias("body"), "distance")
