"""Point-in-time sampling: keyframes, spans, interpolation, gates, segments.

Key tables are long: ``(track, frame, ...)``. A sample at one time needs a key on
each side, found by one partial aggregation per track (``max_by``/``min_by``), so
a track with any number of keys is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import quaternion as Q


def canonical_keyframes(total_frames: Column, stride: Column) -> Column:
    """0, S, 2S, ... and the last frame."""
    last = F.greatest(total_frames - 1, F.lit(0))
    return F.array_union(F.sequence(F.lit(0).cast("int"), last.cast("int"), stride.cast("int")), F.array(last.cast("int")))


def span_at(keys: Sequence[float], at: float) -> tuple[int, int, float]:
    """Left key, right key and position between them for one time; clamped at both ends."""
    if at <= keys[0]:
        return 0, 0, 0.0
    if at >= keys[-1]:
        return len(keys) - 1, len(keys) - 1, 0.0
    right = next(i for i, k in enumerate(keys) if at <= k)
    left = right - 1
    return left, right, (at - keys[left]) / (keys[right] - keys[left])


def keyframes_needed(keys: Sequence[float], at: float) -> list[int]:
    """The keys that playback at ``at`` holds: left, right and the one after."""
    left, right, _ = span_at(keys, at)
    return list(dict.fromkeys([left, right, min(right + 1, len(keys) - 1)]))


def bracket(keys: DataFrame, at: Column, track: str = "track", frame: str = "frame", value: str = "value") -> DataFrame:
    """``(track, lf, lv, rf, rv)``: each track's last key at or before ``at`` and first at or after it.

    Outside a track's keys both sides are its nearest end.
    """
    f, v = F.col(frame), F.col(value)
    sides = keys.groupBy(track).agg(
        F.max_by(F.struct(f, v), F.when(f <= at, f)).alias("l"), F.min_by(F.struct(f, v), F.when(f >= at, f)).alias("r")
    )
    left, right = F.coalesce("l", "r"), F.coalesce("r", "l")
    return sides.select(track, left[frame].alias("lf"), left[value].alias("lv"), right[frame].alias("rf"), right[value].alias("rv"))


def sample_linear(keys: DataFrame, at: Column, track: str = "track", frame: str = "frame", value: str = "value", extended: bool = False) -> DataFrame:
    """``(track, alpha, value)`` at one time; ``extended`` keeps minus infinity absorbing."""
    b = bracket(keys, at, track, frame, value)
    alpha = N.span_alpha(at, F.col("lf"), F.col("rf"))
    blend = N.extended_lerp if extended else N.lerp
    return b.select(track, alpha.alias("alpha"), blend(F.col("lv"), F.col("rv"), alpha).alias("value"))


def sample_sparse(keys: DataFrame, track: str = "track", frame: str = "frame", value: str = "value", kept: str = "kept") -> DataFrame:
    """Rebuild every key from the kept ones: interpolation between the nearest kept neighbours, ends held."""
    before = Window.partitionBy(track).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(track).orderBy(frame).rowsBetween(0, Window.unboundedFollowing)
    knot = F.when(F.col(kept), F.struct(F.col(frame).cast("double").alias("f"), F.col(value).alias("v")))
    l, r = F.last(knot, ignorenulls=True).over(before), F.first(knot, ignorenulls=True).over(after)
    rows = keys.withColumns({"_l": F.coalesce(l, r), "_r": F.coalesce(r, l)})
    alpha = N.span_alpha(F.col(frame), F.col("_l.f"), F.col("_r.f"))
    return rows.withColumn("rebuilt", N.lerp(F.col("_l.v"), F.col("_r.v"), alpha)).drop("_l", "_r")


def opacity(at: Column, logit: Column, mu: Column, width: Column, baked: Column | bool = False) -> Column:
    """Sampled opacity: sigmoid of the logit, gated by the lifetime unless timing is baked in."""
    gate = N.lifetime_gate(at, mu, width)
    baked = F.lit(baked) if isinstance(baked, bool) else baked
    return N.sigmoid(logit) * F.when(baked, 1.0).otherwise(gate)


def over_frames(points: DataFrame, frames: Sequence[float]) -> DataFrame:
    """Each point at each of a few frames."""
    return points.withColumn("frame", F.explode(F.array(*[F.lit(float(f)) for f in frames])))


def order_segments(segments: DataFrame) -> DataFrame:
    """``position`` of each segment: by first frame if every name has a range, else by input order.

    ``segments`` is a small dimension: one row per file, hence one window over it.
    """
    first, last = F.regexp_extract("name", r"(\d+)[_-](\d+)(?!.*\d[_-]\d)", 1), F.regexp_extract("name", r"(\d+)[_-](\d+)(?!.*\d[_-]\d)", 2)
    rows = segments.withColumns({"first_frame": first.try_cast("int"), "last_frame": last.try_cast("int")})
    named = F.min(F.col("first_frame").isNotNull()).over(Window.partitionBy())
    order = F.row_number().over(Window.orderBy(F.when(F.col("_named"), F.col("first_frame")), "file_index"))
    return rows.withColumn("_named", named).withColumn("position", order - 1).drop("_named")


def gaps(ordered: DataFrame) -> DataFrame:
    """Neighbouring segments that do not share their boundary frame."""
    w = Window.orderBy("position")
    prev = F.lag("last_frame").over(w)
    return ordered.withColumn("previous_last", prev).where(F.col("previous_last").isNotNull() & (F.col("previous_last") != F.col("first_frame")))


def locate(frames: DataFrame, segments: DataFrame, at: str = "at") -> DataFrame:
    """Each global frame's segment, local frame and source frame.

    Time starts at the first segment's first frame and is clamped to the last one's
    last; a shared boundary belongs to the later segment. ``segments`` (position,
    first_frame, last_frame) is one row per file and joined as a range.
    """
    ends = segments.agg(F.min("first_frame").alias("_lo"), F.max("last_frame").alias("_hi"))
    starts = segments.agg(F.sort_array(F.collect_list(F.struct("first_frame", "position"))).alias("_starts"))
    rows = frames.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(starts))
    source = F.least(F.greatest(F.col(at).cast("double"), F.lit(0.0)) + F.col("_lo"), F.col("_hi").cast("double"))
    rows = rows.withColumn("source_frame", source)
    hit = F.element_at(F.filter("_starts", lambda s: s["first_frame"] <= F.col("source_frame")), -1)
    return rows.withColumn("_hit", hit).select(at, F.col("_hit.position").alias("segment"), (F.col("source_frame") - F.col("_hit.first_frame")).alias("local_frame"), "source_frame")


def moving(position: Column, velocity: Column, at: Column, centre: Column) -> Column:
    """Linear motion with every step rounded to single precision."""
    f32 = lambda c: c.cast("float").cast("double")
    return f32(f32(position) + f32(f32(velocity) * f32(at - centre)))


def visible_logit(logit: Column, at: Column, centre: Column, sigma: Column, radius: Column) -> Column:
    """Logit after a Gaussian tail outside ``radius`` frames of ``centre``."""
    tail = F.greatest(F.abs(at - centre) - radius, F.lit(0.0))
    ratio = tail / F.greatest(sigma, F.lit(1e-6))
    return N.logit(N.sigmoid(logit) * F.exp(-(ratio * ratio)))


def offline_rotation_keys(keys: DataFrame, track: str = "track", k: str = "k") -> DataFrame:
    """Rotations qw..qz normalized and turned into their predecessor's hemisphere, key after key.

    A key is turned if its product with the one before, as that one came out, is
    negative; so signs follow from the number of negative products up to the key.
    """
    names = ("qw", "qx", "qy", "qz")
    unit = keys.withColumn("_q", Q.normalize(Q.quat(*[F.col(c) for c in names])))
    order = Window.partitionBy(track).orderBy(k)
    turned = F.coalesce(Q.dot(F.lag("_q").over(order), F.col("_q")) < 0, F.lit(False)).cast("int")
    sign = F.when(F.sum("_t").over(order) % 2 == 1, -1.0).otherwise(1.0)
    rows = unit.withColumn("_t", turned).withColumn("_s", sign)
    return rows.withColumns({n: F.col(f"_q.{n[1]}") * F.col("_s") for n in names}).drop("_q", "_t", "_s")


def offline_value(left: Column, right: Column, alpha: Column) -> Column:
    """Linear interpolation in which minus infinity at either end of a span wins, even on a key; one key alone keeps its value."""
    low = F.lit(float("-inf"))
    return F.when(left.isNull() | right.isNull(), F.coalesce(left, right)).when((left == low) | (right == low), low).otherwise(left + (right - left) * alpha)


def offline_sample(keys: DataFrame, at: float, total_frames: int, values: Sequence[str], track: str = "track", frame: str = "frame") -> DataFrame:
    """``(track, *values)`` at one frame, without clamping: a frame outside the clip raises ValueError.

    Between keys values are interpolated; at or before the first key and at or
    after the last one that key's value holds. A frame on a later key is the end
    of the span before it, so a minus infinity at that span's start counts too.
    """
    if not 0 <= at <= total_frames - 1:
        raise ValueError(f"frame {at} is outside 0 to {total_frames - 1}")
    entry = F.struct(F.col(frame).cast("double").alias("f"), *[F.col(v).cast("double").alias(v) for v in values])
    ends = keys.groupBy(track).agg(
        F.min(frame).alias("_first"), F.max(frame).alias("_last"), F.max_by(entry, F.when(F.col(frame) < at, F.col(frame))).alias("_l"), F.min_by(entry, F.when(F.col(frame) >= at, F.col(frame))).alias("_r"),
        F.min_by(entry, frame).alias("_head"), F.max_by(entry, frame).alias("_tail"),
    )
    alpha = (at - F.col("_l.f")) / (F.col("_r.f") - F.col("_l.f"))
    held = lambda v: F.when(F.col("_first") >= at, F.col(f"_head.{v}")).when(F.col("_last") <= at, F.col(f"_tail.{v}"))
    return ends.select(track, *[F.when((F.col("_first") >= at) | (F.col("_last") <= at), held(v)).otherwise(offline_value(F.col(f"_l.{v}"), F.col(f"_r.{v}"), alpha)).alias(v) for v in values])
