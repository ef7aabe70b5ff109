"""Cutting lineage through the folder that all executors share.

A cut writes a table as Parquet under ``spark.checkpoint.dir`` and reads it back. What follows then starts from
files that survive the loss of any executor, carries exact sizes for the optimizer's choice of join, and can be
pruned by column. What a session has written goes with it, at the latest when its driver ends. Only where that setting is absent and the master is local (tests, a laptop) is a temporary folder used.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: dict[int, list[str]] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_own: list[str] = []
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="recordkeep-"))
    return _own[0]


def session_dir(spark: SparkSession) -> str:
    """This session's own folder in the shared one. The driver's file system deletes it when the driver ends."""
    key = spark.sparkContext.applicationId
    if key not in _folders:
        path = f"{shared_dir(spark)}/recordkeep/{key}-{uuid.uuid4().hex}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _folders[key] = path
    return _folders[key]


def cut(df: DataFrame, name: str = "cut", free: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads those files.

    With ``free`` the shuffle files behind it are let go at once: they are deleted when the driver collects its
    garbage, which may otherwise be long after a large cut. ``codec`` is another compression than the session's.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _written.setdefault(id(spark), []).append(path)
    if free:
        free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files deleted that no table at hand is behind any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*cuts: DataFrame) -> None:
    """Delete tables that :func:`cut` returned, before :func:`release` would; only what was written from them stays."""
    for df in cuts:
        if path := _path_of.pop(df, None):
            spark = df.sparkSession
            delete(spark, path)
            _written[id(spark)].remove(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that :func:`cut` wrote in this session, all or those after the first ``since``; what reads them ends with this."""
    paths = _written.get(id(spark), [])[since:]
    for path in paths:
        delete(spark, path)
    del _written.get(id(spark), [])[since:]
    return len(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut inside is deleted behind it, so results have to be written before."""
    since = len(_written.get(id(spark), []))
    try:
        yield
    finally:
        release(spark, since)
