"""Linear-motion point files (4GS, versions 2 and 3): header and footer, and their points as an ordinary clip."""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import files
from .ply import Header, read_header, register

#: The names and sizes of the format.
TITLE = "easytimegspp-4dgs"
FOOTER_MAGIC = b"ET4GSM03"
FOOTER = struct.Struct("<8sQI")
HALF_MAX = 65504.0
REQUIRED = (
    "x y z f_dc_0 f_dc_1 f_dc_2 opacity scale_0 scale_1 scale_2 rot_0 rot_1 rot_2 rot_3 "
    "velocity_per_frame_0 velocity_per_frame_1 velocity_per_frame_2 frame_center sigma_frames radius_frames"
).split()
HARMONICS = {0: 0, 9: 1, 24: 2, 45: 3}


@dataclass
class Clip:
    """What a file says about itself: its PLY header, frames, harmonics and, from version 3 on, its metadata."""

    header: Header
    version: int
    first_frame: int
    last_frame: int
    bands: int
    threshold: float
    frame_rate: float
    trailer: int

    @property
    def frames(self) -> int:
        return self.last_frame - self.first_frame + 1


def _agrees(metadata: dict, names: list[str], count: int, first: int, last: int) -> bool:
    told = [metadata.get(k) for k in ("format", "format_version", "point_count", "property_count", "properties")]
    return told == [TITLE, 3, count, len(names), names] and (metadata.get("time") or {}).get("frames") == list(range(first, last + 1))


def read_clip(path: str) -> Clip:
    """Header, footer and metadata of a file, checked against one another and against its length; faults raise ValueError."""
    header = read_header(path)
    version = re.fullmatch(rf"(?:{TITLE}\s+)?version\s+([23])", f"{header.comments.get(TITLE, '')}")
    if header.encoding != "binary_little_endian" or not version:
        raise ValueError("not a linear-motion file of version 2 or 3")
    vertex = next((e for e in header.elements if e.name == "vertex"), None)
    if vertex is None or not vertex.count or any(t != "f4" for _, t in vertex.properties) or vertex.lists:
        raise ValueError("vertices must be there and be floats")
    names = [n for n, _ in vertex.properties]
    if missing := [n for n in REQUIRED if n not in names]:
        raise ValueError(f"properties are missing: {', '.join(missing)}")
    rest = [n for n in names if n.startswith("f_rest_")]
    if rest != [f"f_rest_{i}" for i in range(len(rest))] or len(rest) not in HARMONICS:
        raise ValueError("harmonics are incomplete")
    first, last, frames = (int(n) for n in header.comments.get("normalized_time_frames", "0 0 0").split()[-3:])
    if frames <= 0 or last - first + 1 != frames:
        raise ValueError("frames must be there and follow one another")
    end = header.size + vertex.count * header.dtype(vertex).itemsize
    length, metadata = files.size(path), {}
    if version[1] == "3":
        with files.open_input(path) as f:
            f.seek(max(0, length - FOOTER.size))
            magic, size, crc = FOOTER.unpack(f.read(FOOTER.size).rjust(FOOTER.size, b"\0"))
            if magic != FOOTER_MAGIC or end + size + FOOTER.size != length:
                raise ValueError("records, metadata and footer do not close")
            f.seek(end)
            data = f.read(size)
        if zlib.crc32(data) != crc:
            raise ValueError("the metadata is damaged")
        metadata = json.loads(data)
        if not _agrees(metadata, names, vertex.count, first, last):
            raise ValueError("the metadata differs from the records")
    elif end != length:
        raise ValueError(f"file of {length} bytes, {end} expected")
    threshold = float(metadata.get("opacity_threshold", header.comments.get("opacity_threshold", "0").split()[-1]))
    if not 0 <= threshold < 1:
        raise ValueError("the opacity threshold must be in [0, 1)")
    rate = (metadata.get("time") or {}).get("frame_rate")
    return Clip(header, int(version[1]), first, last, HARMONICS[len(rest)], threshold, float(rate) if rate and rate > 0 else 30.0, length - end)


def read_points(spark: SparkSession, path: str) -> tuple[Clip, DataFrame]:
    """A file's description and its points with all properties; a value that is not finite, or a negative span, fails the read."""
    clip = read_clip(path)
    register(spark)
    rows = spark.read.format("pointply").option("trailer", clip.trailer).load(path).drop("source_element")

    def sound(name: str) -> Column:
        wrong = F.isnan(name) | (F.abs(name) == float("inf")) | (F.col(name) < 0 if name in ("sigma_frames", "radius_frames") else F.lit(False))
        return F.when(wrong, F.raise_error(F.concat(F.lit(f"{name} of a point is wrong: "), F.col("stable_id").cast("string"))).cast("float")).otherwise(F.col(name)).alias(name)

    return clip, rows.select("stable_id", *[sound(n) for n in rows.columns if n != "stable_id"])


def lifetimes(points: DataFrame, clip: Clip) -> DataFrame:
    """Points with ``lifetime_mu``, ``lifetime_w`` and the positions at both ends of their lives, ``xyz_bank_0_*`` and ``xyz_bank_1_*``.

    A life reaches as far from its centre as the visibility's Gaussian tail stays
    above the threshold (three sigmas without one), within the clip.
    """
    centre, sigma, radius = (F.col(c).cast("double") for c in ("frame_center", "sigma_frames", "radius_frames"))
    if clip.threshold > 0:
        spare = N.log_sigmoid(F.col("opacity").cast("double")) - math.log(clip.threshold)
        reach = F.when(spare < 0, 0.0).otherwise(radius + sigma * F.sqrt(F.greatest(spare, F.lit(0.0))))
    else:
        reach = radius + sigma * 3
    within = lambda at: F.greatest(F.lit(float(clip.first_frame)), F.least(F.lit(float(clip.last_frame)), at))
    rows = points.withColumns({"_from": within(centre - reach), "_to": within(centre + reach)})
    ends = [("0", "_from"), ("1", "_to")] if clip.frames > 1 else [("0", "_from")]
    at = lambda a, i, end: (F.col(a).cast("double") + F.col(f"velocity_per_frame_{i}").cast("double") * (F.col(end) - centre)).cast("float")
    banks = {f"xyz_bank_{k}_{i}": at(a, i, end) for k, end in ends for i, a in enumerate("xyz")}
    first = float(clip.first_frame)
    lives = {"lifetime_mu": ((F.col("_from") + F.col("_to")) / 2 - first).cast("float"), "lifetime_w": ((F.col("_to") - F.col("_from")) / 2).cast("float")}
    return rows.withColumns(banks | lives).drop("_from", "_to")


def visible_logits(points: DataFrame, clip: Clip) -> DataFrame:
    """``(stable_id, frame, logit)``: each point's logit at each frame, frames counted from 0; every step in single precision."""
    f32 = lambda c: c.cast("float").cast("double")
    frame = F.explode(F.sequence(F.lit(0), F.lit(clip.frames - 1))).alias("frame")
    rows = points.select("stable_id", *[F.col(c).cast("double").alias(c) for c in ("opacity", "frame_center", "sigma_frames", "radius_frames")], frame)
    tail = F.greatest(F.abs(F.col("frame") + clip.first_frame - F.col("frame_center")) - F.col("radius_frames"), F.lit(0.0))
    ratio = tail / F.greatest("sigma_frames", F.lit(1e-6))
    alpha = f32(f32(1 / (1 + F.exp(-F.col("opacity")))) * f32(F.exp(f32(-(ratio * ratio)))))
    hidden = (alpha <= 0) | ((alpha < F.lit(clip.threshold).cast("float").cast("double")) if clip.threshold > 0 else F.lit(False))
    logit = F.ln(alpha) - F.log1p(-alpha)
    logit = F.when(hidden, -HALF_MAX).when(alpha >= 1, HALF_MAX).otherwise(F.greatest(F.lit(-HALF_MAX), F.least(F.lit(HALF_MAX), logit)))
    return rows.select("stable_id", "frame", logit.cast("float").alias("logit"))


def footer(names: list[str], count: int, first: int, last: int, threshold: float = 0.0, frame_rate: float = 30.0) -> bytes:
    """Metadata and footer that follow the records of a version 3 file."""
    facts = {"format": TITLE, "format_version": 3, "point_count": count, "property_count": len(names), "properties": names, "opacity_threshold": threshold}
    data = json.dumps(facts | {"time": {"frames": list(range(first, last + 1)), "frame_rate": frame_rate}}).encode()
    return data + FOOTER.pack(FOOTER_MAGIC, len(data), zlib.crc32(data))
