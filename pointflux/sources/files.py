"""Files on any file system Arrow knows: local paths and URIs of object stores alike, opened from driver and workers."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def size(path: str) -> int:
    where, name = _at(path)
    return where.get_file_info(name).size


def open_input(path: str) -> pa.NativeFile:
    """A file to read and seek in."""
    where, name = _at(path)
    return where.open_input_file(name)


def open_output(path: str) -> pa.NativeFile:
    """A file to write anew; its folder is made if missing."""
    where, name = _at(path)
    where.create_dir(os.path.dirname(name), recursive=True)
    return where.open_output_stream(name)
