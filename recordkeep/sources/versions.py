"""Numbered versions of a folder: the next one is created only if it is not there yet, so of two writers one fails.

A version is a small JSON file ``_versions/<number>.json`` that names its parent, its tables' folder and what they hold.
Its number is one above the version that the writer read, and the file appears with its content or not at all: by a
hard link on a local or mounted file system, by a rename that refuses an existing target elsewhere (HDFS and others
whose rename is atomic; on an object store without one, put a table format with its own commit in front). Readers take
the largest number and see one chain: no folder of a version is ever written again.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from recordkeep.plans.lineage import delete

FOLDER = "_versions"


class Conflict(RuntimeError):
    """Another writer has published on the same version."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create_new(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with its content unless one is there; False if so. Of several at once exactly one succeeds."""
    target, fs = _fs(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    if fs.getUri().getScheme() == "file":
        own, final = draft.toUri().getPath(), target.toUri().getPath()
        with open(own, "w", encoding="utf-8") as out:
            out.write(content)
        try:
            os.link(own, final)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, target, none)
    except Exception as error:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True


def latest(spark: SparkSession, root: str) -> int:
    """Number of the newest version, 0 if there is none."""
    folder, fs = _fs(spark, f"{root}/{FOLDER}")
    if not fs.exists(folder):
        return 0
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def describe(spark: SparkSession, root: str, version: int) -> dict:
    """What a version states: parent, snapshot_id, path, tables and the facts given on publishing."""
    path, fs = _fs(spark, f"{root}/{FOLDER}/{version:012d}.json")
    stream = fs.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return json.loads(text)


def history(spark: SparkSession, root: str) -> list[dict]:
    """All versions, oldest first. A chain: each one's parent is the one before it."""
    return [describe(spark, root, v) for v in range(1, latest(spark, root) + 1)]


def commit(spark: SparkSession, root: str, base: int, snapshot_id: str, tables: dict[str, DataFrame], **facts) -> int:
    """Write the tables into a folder of their own, then create the version after ``base``; :class:`Conflict` if it exists.

    What a losing writer wrote is deleted; what a dying one leaves is named by no version.
    """
    if latest(spark, root) != base:
        raise Conflict(f"version {base} is not the newest of {root}")
    path = f"data/{snapshot_id}-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{root}/{path}/{name}")
        stated = {"version": base + 1, "parent": base, "snapshot_id": snapshot_id, "path": path, "tables": sorted(tables), **facts}
        won = create_new(spark, f"{root}/{FOLDER}/{base + 1:012d}.json", json.dumps(stated, sort_keys=True))
    except BaseException:
        delete(spark, f"{root}/{path}")
        raise
    if not won:
        delete(spark, f"{root}/{path}")
        raise Conflict(f"version {base + 1} of {root} is another writer's")
    return base + 1


def read(spark: SparkSession, root: str, version: int, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{describe(spark, root, version)['path']}/{name}")
