"""Point tables to PLY bytes: one row per file part, headers made from the schema.

A file's records are encoded in batches on the executors; the parts are binary
rows in order, so a writer appends them and no task holds a whole file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, ply
from ..storage import stage

#: A bigint is written as 32 bits without sign; one that does not fit, or any null integer, is an error.
KINDS = {"tinyint": ("char", "<i1"), "smallint": ("short", "<i2"), "int": ("int", "<i4"), "bigint": ("uint", "<u4"), "float": ("float", "<f4"), "double": ("double", "<f8")}


def header(columns: Sequence[tuple[str, str]], count: int, comments: dict[str, str] | None = None, element: str = "vertex", half: Sequence[str] = ()) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", *[f"comment {k} {v}" for k, v in (comments or {}).items()], f"element {element} {count}"]
    lines += [f"property {'ushort' if n in half else KINDS[t][0]} {n}" for n, t in columns]
    return ("\n".join([*lines, "end_header"]) + "\n").encode()


def encode(points: DataFrame, columns: Sequence[str], order: str, part_rows: int = 65_536, half: Sequence[str] = ()) -> DataFrame:
    """``(part, n, data)``: records of ``part_rows`` consecutive ids each, sorted by ``order``; ``half`` columns in half precision."""
    kinds = [(c, points.schema[c].dataType.simpleString()) for c in columns]
    dtype = np.dtype([(c, "<u2" if c in half else KINDS[t][1]) for c, t in kinds])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rows = np.zeros(len(pdf), dtype)
        for c, kind in kinds:
            values = pdf[c]
            if kind in ("tinyint", "smallint", "int", "bigint"):
                if values.isna().any():
                    raise ValueError(f"{c} holds null, which an integer property cannot")
                if kind == "bigint" and not values.between(0, 2**32 - 1).all():
                    raise ValueError(f"{c} does not fit into 32 bits without sign; write it as double")
            rows[c] = values.to_numpy().astype(np.float16).view(np.uint16) if c in half else values.to_numpy()
        return pd.DataFrame({"part": [key[0]], "n": [len(pdf)], "data": [rows.tobytes()]})

    return points.withColumn("_part", F.floor(F.col(order) / part_rows)).groupBy("_part").applyInPandas(run, "part long, n long, data binary")


def write_file(points: DataFrame, path: str, columns: Sequence[str], order: str, comments: dict[str, str] | None = None, trailer: bytes = b"", half: Sequence[str] = ()) -> int:
    """Write one file; returns its records. Parts come to the driver one at a time, ``trailer`` follows them. No records are an error."""
    parts = encode(points, columns, order, half=half).orderBy("part")
    comments = (comments or {}) | ({"fp16_quantized": "1"} if half else {})
    count = points.count()
    if not count:
        raise ValueError("nothing is left to export")
    with files.open_output(path) as f:
        f.write(header([(c, points.schema[c].dataType.simpleString()) for c in columns], count, comments, half=half))
        for row in parts.toLocalIterator():
            f.write(row["data"])
        f.write(trailer)
    return count


def compacted(points: DataFrame, edits: DataFrame, key: Sequence[str] = ("segment_id", "stable_id")) -> DataFrame:
    """Points that were not deleted."""
    return points.join(edits.where("deleted").select(*key), list(key), "left_anti")


def sequence_names(frames: DataFrame, frame: str = "frame") -> DataFrame:
    return frames.withColumn("file", F.concat(F.lit("frame_"), F.lpad(F.col(frame).cast("string"), 6, "0"), F.lit(".ply")))


def compact_source(spark: SparkSession, path: str, deleted: DataFrame, out: str, stable_id: str = "stable_id", rows: int = 65_536) -> int:
    """Copy a binary point file without the ``deleted`` stable ids; returns the records kept.

    Kept records are copied byte for byte, elements one after the other, and of the
    header only their counts change. Records are read by ranges on the executors;
    parts come to the driver one at a time. No records left are an error.
    """
    head = ply.read_header(path)
    if head.encoding == "ascii" or any(e.lists for e in head.elements):
        raise ValueError("only binary files of fixed records are copied")
    ply.check_length(head, files.size(path))
    ranges, first = [], 0
    for i, e in enumerate(head.elements):
        width = head.dtype(e).itemsize
        ranges += [(i, at, min(rows, e.count - at), first + at, head.offset(e) + at * width, width) for at in range(0, e.count, rows)]
        first += e.count
    parts = spark.createDataFrame(ranges, "element int, at long, n int, id0 long, start long, width int").repartition(max(1, min(len(ranges), 10_000)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with files.open_input(path) as f:
            for pdf in batches:
                for r in pdf.itertuples():
                    f.seek(r.start)
                    data = f.read(r.n * r.width)
                    records = [data[k * r.width : (k + 1) * r.width] for k in range(r.n)]
                    yield pd.DataFrame({"element": r.element, "at": r.at, stable_id: range(r.id0, r.id0 + r.n), "record": records})

    records = parts.mapInPandas(read, f"element int, at long, {stable_id} long, record binary")
    kept = records.join(deleted.select(stable_id).distinct(), stable_id, "left_anti")

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"element": [key[0]], "at": [key[1]], "n": [len(pdf)], "data": [b"".join(pdf.sort_values(stable_id)["record"])]})

    done = stage(kept.groupBy("element", "at").applyInPandas(join, "element int, at long, n long, data binary"), "records")
    counts = {r["element"]: r["n"] for r in done.groupBy("element").agg(F.sum("n").alias("n")).collect()}  # a row for each element
    if not sum(counts.values()):
        raise ValueError("nothing is left to export")
    with files.open_input(path) as f:
        text = f.read(head.size).decode("ascii")
    for i, e in enumerate(head.elements):
        text = re.sub(rf"(?m)^(element\s+{re.escape(e.name)}\s+)\d+(\s*)$", rf"\g<1>{counts.get(i, 0)}\g<2>", text, count=1)
    with files.open_output(out) as f:
        f.write(text.encode("ascii"))
        for row in done.orderBy("element", "at").toLocalIterator():
            f.write(row["data"])
    return sum(counts.values())
