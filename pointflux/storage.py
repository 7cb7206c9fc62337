"""Written tables: every intermediate that cuts lineage is Parquet in the folder that all executors share.

A lost executor then costs a re-read, never a recomputation from a missing block.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; an own folder only where none is set.

    A local session then gets a temporary folder. Any other master gets a folder
    below the warehouse, unless that is machine-local: then this is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        if spark.sparkContext.master.split("[")[0] == "local":
            _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="pointflux-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if "://" not in warehouse:
                raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {warehouse} may be machine-local")
            _own_dir[app] = warehouse.rstrip("/") + "/_pointflux_tables"
    return _own_dir[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage, no recomputation."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end; results read from them must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)
