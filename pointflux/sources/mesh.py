"""Meshes in PLY files: vertices with normals and colours, faces as lists, cut into triangle fans."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .ply import CHUNK_ROWS, Element, Header, read_header, register

#: Short names of colours, and the columns of a vertex with their defaults.
SHORT = {"r": "red", "g": "green", "b": "blue", "a": "alpha"}
VERTEX = {"x": None, "y": None, "z": None, "nx": 0.0, "ny": 0.0, "nz": 0.0, "red": 255, "green": 255, "blue": 255, "alpha": 255}
FACE = "vertex_indices"


def fans(t0: int, polygon: list[int], vertices: int) -> list[tuple[int, int, int]]:
    """The triangles of a polygon, all from its first corner; a corner that is no vertex raises ValueError."""
    if polygon and not 0 <= min(polygon) <= max(polygon) < vertices:
        raise ValueError(f"face {t0} names a vertex that is not there")
    return [(polygon[0], polygon[i], polygon[i + 1]) for i in range(1, len(polygon) - 1)]


def _numbers(header: Header, path: str, upto: int) -> Iterator[object]:
    """A reader of single values, placed at element ``upto``; each value it is sent for is named by its type."""
    with files.open_input(path) as f:
        f.seek(header.size)
        if header.encoding == "ascii":
            words = (w for line in io.TextIOWrapper(io.BufferedReader(f), "ascii") for w in line.split())
            take = lambda kind, n: [float(next(words)) for _ in range(n)]  # noqa: E731, ARG005
        else:
            order = ">" if header.encoding == "binary_big_endian" else "<"
            data = io.BufferedReader(f, 1 << 20)
            take = lambda kind, n: np.frombuffer(data.read(n * np.dtype(kind).itemsize), order + kind).tolist()
        for e in header.elements[:upto]:
            for _ in range(e.count):
                _record(e, take)
        yield take


def _record(element: Element, take) -> dict[str, list]:  # noqa: ANN001
    out = {}
    for name, kind in element.properties:
        n, item = 1, kind
        if name in element.lists:
            n, item = int(take(element.lists[name][0], 1)[0]), element.lists[name][1]
        out[name] = take(item, n)
    return out


def _triangles(path: str, header: Header) -> Iterator[pd.DataFrame]:
    at = next((i for i, e in enumerate(header.elements) if e.name == "face"), None)
    vertices = next((e.count for e in header.elements if e.name == "vertex"), 0)
    if at is None:
        return
    rows: list[tuple[int, int, int]] = []
    t0 = 0
    for take in _numbers(header, path, at):
        for k in range(header.elements[at].count):
            rows += fans(k, [int(v) for v in _record(header.elements[at], take).get(FACE, [])], vertices)
            if len(rows) >= CHUNK_ROWS:
                yield pd.DataFrame({"t": range(t0, t0 + len(rows)), **dict(zip("abc", zip(*rows, strict=True), strict=True))})
                t0, rows = t0 + len(rows), []
        if rows:
            yield pd.DataFrame({"t": range(t0, t0 + len(rows)), **dict(zip("abc", zip(*rows, strict=True), strict=True))})


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``vertices(v, x, y, z, nx, ny, nz, red, green, blue, alpha)`` and ``triangles(t, a, b, c)`` of a file.

    Vertices are read by ranges; faces have no fixed size, so one task reads them,
    a chunk at a time. Missing normals are 0, missing colours 255; colours are
    rounded into 0 to 255. Coordinates that are not finite, and a face that names
    no vertex, fail the read.
    """
    header = read_header(path)
    element = next((e for e in header.elements if e.name == "vertex"), None)
    if element is None or not element.count:
        raise ValueError("the file has no vertices")
    register(spark)
    rows = spark.read.format("pointply").load(path).where("source_element = 'vertex'")
    names = {SHORT.get(n, n): n for n, _ in element.properties}
    sound = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("a coordinate is not finite")).cast("float")).otherwise(c)
    columns = []
    for name, default in VERTEX.items():
        value = F.col(names[name]).cast("float") if name in names else F.lit(default).cast("float")
        if isinstance(default, int):
            value = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(value + 0.5))).cast("int")
        columns.append((sound(value) if default is None else value).alias(name))
    vertices = rows.select(F.col("stable_id").alias("v"), *columns)
    triangles = spark.range(0, 1, 1, 1).mapInPandas(lambda it: (b for _ in it for b in _triangles(path, header)), "t long, a long, b long, c long")
    return vertices, triangles


def write_mesh(vertices: DataFrame, triangles: DataFrame, path: str, part_rows: int = 65_536) -> tuple[int, int]:
    """Write vertices (28 bytes each) and triangles (13 bytes each) as a binary file; returns their numbers.

    ``vertices(v, x, y, z)`` number 0, 1, ... without gaps, else writing fails; normals
    and colours are optional. Triangles go by ``t``. An empty mesh is an error.
    """
    have = vertices.columns
    vertex = np.dtype([(n, "u1" if isinstance(d, int) else "<f4") for n, d in VERTEX.items()])
    face = np.dtype([("n", "u1"), ("a", "<u4"), ("b", "<u4"), ("c", "<u4")])
    full = vertices.select("v", *[F.coalesce(F.col(n), F.lit(d)).alias(n) if n in have and d is not None else F.col(n) if d is None else F.lit(d).alias(n) for n, d in VERTEX.items()])

    def encode(rows: DataFrame, order: str, dtype: np.dtype, fixed: dict[str, int]) -> DataFrame:
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            out = np.zeros(len(pdf), dtype)
            for n in dtype.names:
                out[n] = fixed[n] if n in fixed else pdf[n].to_numpy()
            return pd.DataFrame({"part": [key[0]], "data": [out.tobytes()]})

        return rows.withColumn("_part", F.floor(F.col(order) / part_rows)).groupBy("_part").applyInPandas(run, "part long, data binary").orderBy("part")

    counted = vertices.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count_distinct("v").alias("d")).first()
    m = triangles.count()
    if not counted["n"] or not m:
        raise ValueError("an empty mesh has no file")
    if (counted["low"], counted["high"], counted["d"]) != (0, counted["n"] - 1, counted["n"]):
        raise ValueError("vertices must number 0, 1, ... without gaps")
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {counted['n']}"]
    lines += [f"property {'uchar' if isinstance(d, int) else 'float'} {n}" for n, d in VERTEX.items()]
    lines += [f"element face {m}", f"property list uchar uint {FACE}", "end_header"]
    with files.open_output(path) as f:
        f.write(("\n".join(lines) + "\n").encode())
        for part in (encode(full, "v", vertex, {}), encode(triangles, "t", face, {"n": 3})):
            for row in part.toLocalIterator():
                f.write(row["data"])
    return counted["n"], m
