"""Streaming forms of the incremental operations. State is a folder of buckets; a micro-batch rewrites those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordkeep.operators.links import LEAF


ORDER, BUCKET, VERSION = "_order", "bucket", "version"


def latest_per_leaf(links: DataFrame, order: str, previous_wins: bool = False) -> DataFrame:
    """The last link per leaf with its order; of equal ``order`` the largest address (smallest and first, if ``previous_wins``)."""
    pick, edge = (F.min_by, F.min) if previous_wins else (F.max_by, F.max)
    return links.groupBy(*LEAF).agg(pick("url", F.struct(order, "url")).alias("url"), edge(order).alias(ORDER))


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _version(spark: SparkSession, state: str) -> int | None:
    """The highest complete version under ``state``."""
    path, fs = _path(spark, f"{state}/manifest")
    if not fs.exists(path):
        return None
    names = [s.getPath().toString() for s in fs.listStatus(path)]
    done = [int(p.rsplit("=", 1)[1]) for p in names if f"{VERSION}=" in p and fs.exists(_path(spark, f"{p}/_SUCCESS")[0])]
    return max(done, default=None)


def _buckets(spark: SparkSession, state: str, version: int) -> dict[int, int]:
    """Bucket -> version that wrote it last; as many rows as there are buckets."""
    return {r[BUCKET]: r["written"] for r in spark.read.schema(f"{BUCKET} int, written int").parquet(f"{state}/manifest/{VERSION}={version}").collect()}


def _rows(spark: SparkSession, state: str, buckets: dict[int, int]) -> DataFrame:
    return spark.read.parquet(*[f"{state}/data/{VERSION}={v}/{BUCKET}={b}" for b, v in sorted(buckets.items())])


def read_state(spark: SparkSession, state: str, version: int | None = None, with_order: bool = False) -> DataFrame | None:
    version = _version(spark, state) if version is None else version
    if version is None:
        return None
    buckets = _buckets(spark, state, version)
    if not buckets:
        return None
    rows = _rows(spark, state, buckets)
    return rows if with_order else rows.drop(ORDER)


def stream_overlay(links: DataFrame, state: str, checkpoint: str, order: str, previous_wins: bool = False, buckets: int = 64) -> StreamingQuery:
    """A stream of (leaf, url, order) laid over the state; equals the batch overlay of everything that came, in any order.

    The state keeps each leaf's order, so that a row that arrives late never replaces a newer one. It lies in buckets by
    hash of the leaf; a batch rewrites the buckets that it touches and a manifest that names each bucket's files, written
    last. A batch that is run again writes the same version again. Files that the last two manifests do not name go.
    """
    pick = F.pmod(F.xxhash64(*LEAF), F.lit(buckets)).cast("int")

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _buckets(spark, state, number - 1) if number else {}
        own = latest_per_leaf(batch, order, previous_wins).withColumn(BUCKET, pick).persist()
        touched = [r[0] for r in own.select(BUCKET).distinct().collect()]
        known = {b: before[b] for b in touched if b in before}
        merged = own.drop(BUCKET) if not known else latest_per_leaf(own.drop(BUCKET).unionByName(_rows(spark, state, known)), ORDER, previous_wins)
        written = {**before, **dict.fromkeys(touched, number)}
        if touched:
            merged.withColumn(BUCKET, pick).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{state}/data/{VERSION}={number}")
        spark.createDataFrame(sorted(written.items()), f"{BUCKET} int, written int").coalesce(1).write.mode("overwrite").parquet(f"{state}/manifest/{VERSION}={number}")
        own.unpersist()
        if number > 1:  # version number - 1 stays whole, for a batch that is run again
            for bucket, version in _buckets(spark, state, number - 2).items():
                if before.get(bucket) != version:
                    path, fs = _path(spark, f"{state}/data/{VERSION}={version}/{BUCKET}={bucket}")
                    fs.delete(path, True)

    return links.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_records(records: DataFrame, time: str, within: str, key: str = "code") -> DataFrame:
    """The first of each key within a watermark."""
    return records.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def unseen_batch(batch: DataFrame, snapshot: DataFrame, order: str, key: str = "code") -> DataFrame:
    """X2 against a snapshot, for foreachBatch: keys that it lacks, the first row of each."""
    fresh = batch.join(snapshot.select(key), key, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def stream_gate_counts(rows: DataFrame, gates, out: str, checkpoint: str) -> StreamingQuery:
    """Per micro-batch the number of violations by gate, appended to ``out``."""

    def count(batch: DataFrame, number: int) -> None:
        found = gates(batch).groupBy("gate").agg(F.count("*").alias("n"))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
