"""Stream containers: a magic, a JSON manifest and named, digested byte streams."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.streams import planes, unplanes
from .files import open_output

#: Fixed value: the container's first eight bytes.
MAGIC = b"4CGSPRS2"


def pack(manifest: dict, streams: dict[str, bytes], codec: str = "deflate") -> bytes:
    """A container of ``streams``; sizes and SHA-256 digests of raw and stored bytes go into the manifest."""
    entries, body, at = [], [], 0
    for name, raw in streams.items():
        data = {"raw": lambda b: b, "deflate": zlib.compress, "shuffle16-deflate": lambda b: zlib.compress(planes(b))}[codec](raw)
        entries.append({"name": name, "codec": codec, "offset": at, "size": len(data), "rawSize": len(raw), "sha256": hashlib.sha256(data).hexdigest(), "rawSha256": hashlib.sha256(raw).hexdigest()})
        body.append(data)
        at += len(data)
    head = json.dumps(manifest | {"streams": entries}, sort_keys=True).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(body)


def parse(data: bytes) -> tuple[dict, int]:
    """Manifest and start of the streams; the total length must close."""
    if data[:8] != MAGIC:
        raise ValueError("not a container")
    (n,) = struct.unpack("<I", data[8:12])
    manifest = json.loads(data[12 : 12 + n])
    if 12 + n + sum(s["size"] for s in manifest["streams"]) != len(data):
        raise ValueError("the container's length does not close")
    return manifest, 12 + n


def read_streams(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """``(path, stream, codec, data)`` of containers read with ``binaryFile``; damaged streams fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf[name], pdf[content], strict=True):
                manifest, start = parse(data)
                for s in manifest["streams"]:
                    stored = data[start + s["offset"] : start + s["offset"] + s["size"]]
                    if hashlib.sha256(stored).hexdigest() != s["sha256"]:
                        raise ValueError(f"stream {s['name']} is damaged")
                    raw = stored if s["codec"] == "raw" else zlib.decompress(stored)
                    raw = unplanes(raw, s["rawSize"]) if s["codec"].startswith("shuffle16") else raw
                    if hashlib.sha256(raw).hexdigest() != s["rawSha256"]:
                        raise ValueError(f"stream {s['name']} differs from what was stored")
                    yield pd.DataFrame({name: [path], "stream": [s["name"]], "codec": [s["codec"]], "data": [raw]})

    return files.select(name, content).mapInPandas(run, f"{name} string, stream string, codec string, data binary")


def rewrite_manifest(data: bytes, changes: dict) -> bytes:
    """Save under another manifest; stream bytes stay as they are."""
    manifest, start = parse(data)
    head = json.dumps(manifest | changes | {"streams": manifest["streams"]}, sort_keys=True).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + data[start:]


def manifests(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """``(path, version, stream, codec, size, raw_size, raw_sha)``: what the manifests of containers list, nothing inflated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf[name], pdf[content], strict=True):
                manifest, _ = parse(data)
                rows = [(path, manifest.get("version"), s["name"], s["codec"], s["size"], s["rawSize"], s["rawSha256"]) for s in manifest["streams"]]
                yield pd.DataFrame(rows, columns=[name, "version", "stream", "codec", "size", "raw_size", "raw_sha"])

    return files.select(name, content).mapInPandas(run, f"{name} string, version int, stream string, codec string, size long, raw_size long, raw_sha string")


def write_containers(streams: DataFrame, folder: str, version: int = 1, codec: str = "deflate") -> DataFrame:
    """Write a container for each ``file`` of ``streams(file, stream, data)``; returns ``(file, bytes)``.

    Each file is written by the task that holds its streams; a task that runs
    again writes the same bytes again.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stream")
        data = pack({"version": version}, dict(zip(pdf["stream"], pdf["data"], strict=True)), codec)
        with open_output(f"{folder.rstrip('/')}/{key[0]}") as f:
            f.write(data)
        return pd.DataFrame({"file": [key[0]], "bytes": [len(data)]})

    return streams.groupBy("file").applyInPandas(run, "file string, bytes long")


def save_as(files: DataFrame, changes: dict, folder: str, name: str = "path", content: str = "content") -> DataFrame:
    """Write containers again below ``folder`` with a changed manifest and the same stream bytes; returns ``(path, file)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf[name], pdf[content], strict=True):
                file = path.rsplit("/", 1)[-1]
                new = rewrite_manifest(data, changes)
                before, after = parse(data), parse(new)
                if data[before[1] :] != new[after[1] :]:
                    raise ValueError(f"{path} changed when it was saved")
                with open_output(f"{folder.rstrip('/')}/{file}") as f:
                    f.write(new)
                yield pd.DataFrame({name: [path], "file": [file]})

    return files.select(name, content).mapInPandas(run, f"{name} string, file string")


#: What a manifest may and must name.
CODECS = ("raw", "deflate", "deflate-shuffle16", "brotli", "brotli-shuffle16")
TRACKS = ("position", "rotation", "colorDc", "scale", "opacity")
REQUIRED_STREAMS = ("active_masks", "prs_position", "so3_rotation", "tattr_dc", "mixsc_opacity", "lifetime_mu", "lifetime_w", "coresh5r_shared")
SCALE, SCALE_AXES = "tattr_scale", ("tattr_scale_0", "tattr_scale_1", "tattr_scale_2")
BUNDLE = "CoRe4D-Browser-Raw4D-Lossless-DeflateShuffle16-V1"
MANIFEST = (
    "format string, version int, codecName string, slotCount long, uniqueFrameCount long, "
    f"segments array<struct<name:string,gaussianCount:long,totalFrames:long,firstFrame:long,lastFrame:long,positionTiming:string,opacityTiming:string,bankCounts:struct<{','.join(f'{t}:long' for t in TRACKS)}>>>, "
    "streams array<struct<name:string,compression:string,rawBytes:long,storedBytes:long,rawSha256:string,storedSha256:string>>"
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it.

    Spark writes a column out at each place that names it and, inside lambdas,
    computes it at each; a lambda's argument is a value.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def manifest_problems(manifest: Column) -> Column:
    """What is wrong with a JSON manifest, a sorted array of strings; empty: nothing.

    Positive counts, known codecs and timings, digests, frames in order, names
    once each, all streams that sampling needs, and scale either as one stream or
    as all of its three axes. A bundle of source files needs none of those streams.
    """
    no_json = lambda text: F.from_json(text, "_corrupt_record string")["_corrupt_record"].isNotNull()
    parsed = lambda text: F.from_json(F.when(~no_json(text), text), MANIFEST)  # noqa: E731 -- of a text that breaks off nothing counts
    rules = lambda m: bound(F.transform(m["streams"], lambda s: s["name"]), lambda names: _problems(m, names))
    return bound(manifest, lambda text: bound(parsed(text), rules))


def _problems(m: Column, names: Column) -> Column:
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    rule = lambda ok, text: F.when(no(ok), F.lit(text))
    counted = lambda s: (s["gaussianCount"] > 0) & (s["totalFrames"] > 0)
    banked = lambda s: F.forall(F.array(*[s["bankCounts"][t] for t in TRACKS]), lambda n: F.coalesce(n > 0, F.lit(False)))
    timed = lambda s: F.coalesce(s["positionTiming"].isin("shared-keyframes", "per-point-lifetime-endpoints"), F.lit(True)) & F.coalesce(s["opacityTiming"].isin("lifetime-gated", "baked"), F.lit(True))
    digest = lambda c: c.rlike("^[0-9a-fA-F]{64}$")
    every = lambda items, ok: F.forall(items, lambda s: F.coalesce(ok(s), F.lit(False)))
    bundle = F.coalesce(m["codecName"] == BUNDLE, F.lit(False))
    all_axes = F.size(F.array_intersect(names, F.array(*[F.lit(a) for a in SCALE_AXES]))) == 3
    found = [
        rule(m["format"] == "4CGS", "format"), rule(m["version"] == 2, "version"), rule(m["codecName"].isNotNull(), "codecName"),
        rule(m["slotCount"] > 0, "slotCount"), rule(m["uniqueFrameCount"] > 0, "uniqueFrameCount"),
        rule(F.size(m["segments"]) > 0, "segments"), rule(F.size(m["streams"]) > 0, "streams"),
        rule(every(m["segments"], lambda s: s["name"].isNotNull() & counted(s) & banked(s)), "segment counts"),
        rule(every(m["segments"], timed), "segment timing"), rule(every(m["segments"], lambda s: s["lastFrame"] >= s["firstFrame"]), "segment frames"),
        rule(every(m["streams"], lambda s: s["compression"].isin(*CODECS)), "stream codec"),
        rule(every(m["streams"], lambda s: (s["rawBytes"] > 0) & (s["storedBytes"] > 0)), "stream sizes"),
        rule(every(m["streams"], lambda s: digest(s["rawSha256"]) & digest(s["storedSha256"])), "stream digests"),
        rule(F.size(F.array_distinct(names)) == F.size(names), "stream named twice"),
        *[F.when(~bundle & no(F.array_contains(names, n)), F.lit(f"no {n}")) for n in REQUIRED_STREAMS],
        F.when(~bundle & no(F.array_contains(names, SCALE) | all_axes), F.lit("no scale")),
    ]
    return F.sort_array(F.array_compact(F.array(*found)))


def catalog_check(catalog: DataFrame, manifests: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """``(key, problem)``: entries on one side only, repeated ids and fields that differ."""
    c, m = catalog.alias("c"), manifests.alias("m")
    both = c.join(m, F.col(f"c.{key}") == F.col(f"m.{key}"), "full")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"c.{f}").eqNullSafe(F.col(f"m.{f}")), F.lit(f)) for f in fields]))
    problem = F.when(F.col(f"m.{key}").isNull(), "no file").when(F.col(f"c.{key}").isNull(), "not listed").when(F.size(wrong) > 0, F.concat(F.lit("differs: "), F.array_join(wrong, ",")))
    out = both.select(F.coalesce(f"c.{key}", f"m.{key}").alias(key), problem.alias("problem")).where("problem is not null")
    twice = catalog.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("listed twice").alias("problem"))
    return out.union(twice)
