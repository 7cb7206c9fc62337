"""Formats of point files: by name, by content, and how each is opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import container, files, fourgs, ply

#: Formats by file extension.
EXTENSIONS = {"raw4d": "RAW4D", "ply4": "PLY4", "4gs": "4GS", "sog": "SOG", "ply": "PLY", "4cgs": "4CGS"}


def extension(name: Column) -> Column:
    """What follows the last dot of a name, lower-cased; the whole name where there is none."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def format_of(name: Column) -> Column:
    """The format that a file's name says, null if it is none of them."""
    known = F.create_map(*[F.lit(v) for pair in EXTENSIONS.items() for v in pair])
    return F.element_at(known, extension(name))


def sniff(path: str) -> str | None:
    """The format that a file's first bytes say: a container, a point file with keyframes, linear motion or none, or null."""
    with files.open_input(path) as f:
        start = f.read(8)
    if start == container.MAGIC:
        return "4CGS"
    if start[:2] == b"PK":
        return "SOG"
    if start[:3] != b"ply":
        return None
    header = ply.read_header(path)
    if fourgs.TITLE in header.comments:
        return "4GS"
    return "RAW4D" if ply.is_temporal(header) else "PLY"


def open_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of a file of any format that holds rows of points, by what it contains."""
    kind = sniff(path)
    if kind == "4GS":
        clip, points = fourgs.read_points(spark, path)
        return fourgs.lifetimes(points, clip)
    if kind in ("RAW4D", "PLY"):
        ply.register(spark)
        rows = spark.read.format("pointply").load(path)
        frames = int(ply.read_header(path).comments.get("total_frames", "1"))
        return rows if kind == "RAW4D" else ply.with_defaults(rows, frames)
    raise ValueError(f"{path} holds no rows of points that can be read ({kind or 'unknown'})")
