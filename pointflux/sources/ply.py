"""Point files with a PLY header as a Spark data source.

``register(spark)`` adds the format ``pointply``; ``spark.read.format("pointply")
.load(path)`` gives one row per vertex record with its ``stable_id``, and the file
is read by byte ranges of records, so its size bounds no task. The header alone is
read on the driver. Paths may be local ones that every executor shares or URIs of
object stores.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

#: Scalar types of the format and their aliases.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
SQL_TYPES = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f2": "float", "f4": "float", "f8": "double"}
MAX_HEADER = 1 << 20
CHUNK_ROWS = 8_192
BANK = re.compile(r"^(xyz|rot|f_dc|scale|opacity)_bank_?(\d+)(?:_(\d+))?$")


@dataclass
class Element:
    name: str
    count: int
    properties: list[tuple[str, str]] = field(default_factory=list)
    #: Types of length and items of properties that are lists.
    lists: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass
class Header:
    encoding: str
    comments: dict[str, str]
    elements: list[Element]
    size: int

    @property
    def half_floats(self) -> bool:
        """Whether unsigned shorts carry half-precision bit patterns."""
        return self.comments.get("fp16_quantized") == "1"

    def dtype(self, element: Element) -> np.dtype:
        if element.lists:
            raise ValueError(f"records of {element.name} have no fixed size")
        order = ">" if self.encoding == "binary_big_endian" else "<"
        return np.dtype([(n, order + t) for n, t in element.properties])

    def offset(self, element: Element) -> int:
        at = self.size
        for e in self.elements:
            if e is element:
                return at
            at += e.count * self.dtype(e).itemsize
        raise ValueError(f"no element {element.name}")


def parse_header(data: bytes) -> Header:
    """The header at the start of ``data``; malformed ones raise ValueError."""
    end = data.find(b"end_header\n")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("no PLY header within the first MiB")
    encoding, comments, elements = "", {}, []
    for line in data[:end].decode("ascii", "replace").splitlines()[1:]:
        kind, _, rest = line.strip().partition(" ")
        if kind == "format":
            encoding = rest.split()[0]
        elif kind == "comment":
            key, _, value = rest.partition(" ")
            comments[key] = value.strip()
        elif kind == "element":
            name, count = rest.split()
            elements.append(Element(name, int(count)))
        elif kind == "property":
            parts = rest.split()
            if parts[0] == "list":
                if len(parts) != 4 or parts[1] not in TYPES or parts[2] not in TYPES:
                    raise ValueError(f"unsupported property {rest}")
                elements[-1].lists[parts[3]] = TYPES[parts[1]], TYPES[parts[2]]
                parts = [parts[2], parts[3]]
            if parts[0] not in TYPES:
                raise ValueError(f"unsupported property {rest}")
            if any(n == parts[1] for n, _ in elements[-1].properties):
                raise ValueError(f"property {parts[1]} is named twice")
            elements[-1].properties.append((parts[1], TYPES[parts[0]]))
    if encoding not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown format {encoding!r}")
    return Header(encoding, comments, elements, end + len(b"end_header\n"))


def read_header(path: str) -> Header:
    """Read in doubling steps from 4 KiB, a MiB at most."""
    size = 4096
    with files.open_input(path) as f:
        data = f.read(size)
        while b"end_header\n" not in data and size < MAX_HEADER and len(data) == size:
            data += f.read(size)
            size *= 2
    return parse_header(data)


def is_temporal(header: Header) -> bool:
    """Whether a file carries keyframes: a frame count and a position bank."""
    return "total_frames" in header.comments and any(BANK.match(n) and n.startswith("xyz") for e in header.elements for n, _ in e.properties)


def banks(names: list[str]) -> dict[str, int]:
    """Keyframes of each track, inferred from property names."""
    out: dict[str, int] = {}
    for n in names:
        if m := BANK.match(n):
            out[m[1]] = max(out.get(m[1], 0), int(m[2]) + 1)
    return out


def check_length(header: Header, length: int, trailer: int = 0) -> None:
    """Binary payloads must end exactly where the header says, unless lists leave that open."""
    if header.encoding != "ascii" and not any(e.lists for e in header.elements):
        want = header.size + sum(e.count * header.dtype(e).itemsize for e in header.elements) + trailer
        if want != length:
            raise ValueError(f"payload of {length} bytes, {want} expected")


def frame_range(name: str) -> tuple[int, int] | None:
    """The last pair of numbers in a file name, without its extension."""
    found = re.findall(r"(?<!\d)(\d+)[_-](\d+)(?!\d)", re.sub(r"\.[A-Za-z0-9]+$", "", name))
    return (int(found[-1][0]), int(found[-1][1])) if found else None


def _names(header: Header) -> list[tuple[str, str]]:
    seen: dict[str, str] = {}
    for e in header.elements:
        if e.name.startswith("vertex"):
            for n, t in e.properties:
                seen.setdefault(n, "f2" if t == "u2" and header.half_floats else t)
    return list(seen.items())


def _table(rows: np.ndarray, columns: list[tuple[str, str]], first: int, source: str) -> pa.RecordBatch:
    arrays = [pa.array(np.arange(first, first + len(rows))), pa.array([source] * len(rows))]
    for name, kind in columns:
        if kind == "f2":  # half-precision bit patterns
            arrays.append(pa.array(rows[name].astype("=u2").view(np.float16).astype(np.float32)) if name in rows.dtype.names else pa.nulls(len(rows), pa.float32()))
            continue
        arrow = {"i1": pa.int8(), "u1": pa.int16(), "i2": pa.int16(), "u2": pa.int32(), "i4": pa.int32(), "u4": pa.int64(), "f4": pa.float32(), "f8": pa.float64()}[kind]
        arrays.append(pa.array(rows[name].astype(rows[name].dtype.newbyteorder("="))).cast(arrow) if name in rows.dtype.names else pa.nulls(len(rows), arrow))
    return pa.RecordBatch.from_arrays(arrays, names=["stable_id", "source_element", *[n for n, _ in columns]])


class Range(InputPartition):
    """Records ``first`` to ``first + rows`` of an element; ``id0`` is the first one's stable id."""

    def __init__(self, element: int, first: int, rows: int, id0: int) -> None:
        super().__init__((element, first))
        self.element, self.first, self.rows, self.id0 = element, first, rows, id0


class PointPlySource(DataSource):
    """Options: ``columns`` (comma-separated, default all), ``rows`` per task, ``trailer`` bytes that follow the records."""

    @classmethod
    def name(cls) -> str:
        return "pointply"

    def _columns(self) -> list[tuple[str, str]]:
        found = _names(read_header(self.options["path"]))
        wanted = self.options.get("columns")
        return [c for c in found if not wanted or c[0] in wanted.split(",")]

    def schema(self) -> str:
        return "stable_id bigint, source_element string, " + ", ".join(f"`{n}` {SQL_TYPES[t]}" for n, t in self._columns())

    def reader(self, schema: object) -> DataSourceReader:
        return PointPlyReader(self.options["path"], self._columns(), int(self.options.get("rows", 1 << 20)), int(self.options.get("trailer", 0)))


class PointPlyReader(DataSourceReader):
    def __init__(self, path: str, columns: list[tuple[str, str]], rows: int, trailer: int = 0) -> None:
        self.path, self.columns, self.rows, self.trailer = path, columns, max(256, rows), trailer
        self.header = read_header(path)

    def partitions(self) -> list[Range]:
        check_length(self.header, files.size(self.path), self.trailer)
        out, id0 = [], 0
        for i, e in enumerate(self.header.elements):
            if e.name.startswith("vertex"):
                step = e.count if self.header.encoding == "ascii" else self.rows
                out += [Range(i, a, min(step, e.count - a), id0 + a) for a in range(0, e.count, max(1, step))]
                id0 += e.count
        return out or [Range(0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        e = self.header.elements[partition.element]
        dtype = self.header.dtype(e)
        with files.open_input(self.path) as f:
            if self.header.encoding == "ascii":
                yield from self._ascii(f, partition, e)
                return
            f.seek(self.header.offset(e) + partition.first * dtype.itemsize)
            for at in range(0, partition.rows, CHUNK_ROWS):
                n = min(CHUNK_ROWS, partition.rows - at)
                data = f.read(n * dtype.itemsize)
                yield _table(np.frombuffer(data, dtype), self.columns, partition.id0 + at, e.name)


    def _ascii(self, f: pa.NativeFile, partition: Range, e: Element) -> Iterator[pa.RecordBatch]:
        """Lines have no fixed size, so one task reads them, a chunk at a time."""
        f.seek(self.header.size)
        lines = io.TextIOWrapper(io.BufferedReader(f), "ascii")
        for _ in range(sum(x.count for x in self.header.elements[: partition.element])):
            lines.readline()
        native = np.dtype([(n, t) for n, t in e.properties])
        for at in range(0, e.count, CHUNK_ROWS):
            rows = [tuple(np.dtype(t).type(float(v)) for (_, t), v in zip(e.properties, lines.readline().split(), strict=True)) for _ in range(min(CHUNK_ROWS, e.count - at))]
            yield _table(np.array(rows, native), self.columns, partition.id0 + at, e.name)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointPlySource)


def required_columns(names: list[str]) -> list[str]:
    """What sampling needs: keyframe banks, or base columns of tracks without any, lifetimes and harmonics."""
    have = banks(names)
    base = {"xyz": ("x", "y", "z"), "rot": ("rot_0", "rot_1", "rot_2", "rot_3"), "f_dc": ("f_dc_0", "f_dc_1", "f_dc_2"), "scale": ("scale_0", "scale_1", "scale_2"), "opacity": ("opacity",)}
    keep = [n for n in names if BANK.match(n)]
    for track, columns in base.items():
        if track not in have:
            keep += [c for c in columns if c in names]
    return keep + [n for n in names if n.startswith(("lifetime_", "f_rest_"))]


def with_defaults(points: DataFrame, total_frames: int) -> DataFrame:
    """Missing rotation is the identity; missing lifetime spans the clip."""
    c = points.columns
    fill = {f"rot_{i}": F.lit(1.0 if i == 0 else 0.0).cast("float") for i in range(4)}
    fill |= {"lifetime_mu": F.lit((total_frames - 1) / 2).cast("float"), "lifetime_w": F.lit(float(max(1, total_frames))).cast("float")}
    return points.withColumns({k: F.coalesce(k, v) if k in c else v for k, v in fill.items()})


def tracks(points: DataFrame, columns: dict[str, list[str]], stride: dict[str, int] | None = None, keep: tuple[str, ...] = ("stable_id",)) -> DataFrame:
    """``(*keep, track, k, frame, c)``: a row for each key of each track, ``c`` its components.

    ``columns`` lists the banks' columns of each track, all components of a key
    together, as :func:`bank_columns` finds them; keys are ``stride`` frames apart.
    """
    keys = []
    for track, names in columns.items():
        n = 1 + max(int(BANK.match(x)[2]) for x in names)
        per = len(names) // n
        step = (stride or {}).get(track, 1)
        keys += [F.struct(F.lit(track).alias("track"), F.lit(k).alias("k"), F.lit(k * step).alias("frame"), F.array(*[F.col(x).cast("double") for x in names[k * per : (k + 1) * per]]).alias("c")) for k in range(n)]
    return points.select(*keep, F.explode(F.array(*keys)).alias("key")).select(*keep, "key.*")


def bank_columns(names: list[str]) -> dict[str, list[str]]:
    """The bank columns of each track, by key and component; a key or component that is missing raises ValueError."""
    found: dict[str, dict[tuple[int, int], str]] = {}
    for n in names:
        if m := BANK.match(n):
            found.setdefault(m[1], {})[int(m[2]), int(m[3] or 0)] = n
    for track, at in found.items():
        keys, parts = 1 + max(k for k, _ in at), 1 + max(c for _, c in at)
        if len(at) != keys * parts:
            raise ValueError(f"banks of {track} are incomplete")
    return {track: [at[place] for place in sorted(at)] for track, at in found.items()}
