"""A tree of bucket hashes kept with a table, so that two snapshots are compared where they differ and nowhere else.

A row's bucket is the leading bits of a hash of its key. A bucket's hash is an order-free sum over its rows, made by one
aggregation that combines before the shuffle; STEP bits further up, up to 2 ** STEP children make a node, until one root
is left. Tables are written by bucket. Comparing goes down from the roots along nodes that differ, and the scans then
read the buckets found, which are folders: the rest is never opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.functions.text import fingerprint
from recordkeep.operators import refresh
from recordkeep.plans.lineage import cut
from recordkeep.sources.sinks import summed_hash

#: Bits of a bucket number, and bits between two levels of the tree.
BITS, STEP = 8, 4


def bucket(key: list[str], bits: int = BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - bits).cast("int")


def tree(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` (bucket, ...) -> (level, bucket, n, hash): level ``bits`` holds the buckets, level 0 the root.

    Empty buckets have no node; a table without rows has no root.
    """
    if bits % STEP:
        raise ValueError(f"bits are a multiple of {STEP}")
    level = cut(rows.groupBy("bucket").agg(F.count("*").alias("n"), summed_hash(fingerprint(rows, ("bucket",))).alias("hash")), "bucket-hashes")
    out = level.select(F.lit(bits).alias("level"), "bucket", "n", "hash")
    for up in range(bits - STEP, -1, -STEP):
        child = F.struct("bucket", F.concat_ws(":", F.col("bucket").cast("string"), "hash").alias("text"))
        level = level.groupBy(F.shiftright("bucket", STEP).alias("bucket")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["text"]), ","), 256).alias("hash"))
        out = out.unionByName(level.select(F.lit(up).alias("level"), "bucket", "n", "hash"))
    return out


def save(df: DataFrame, key: list[str], path: str, bits: int = BITS) -> None:
    """Write a table by bucket, and its tree beside it."""
    placed = df.withColumn("bucket", bucket(key, bits))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    tree(rows, bits).coalesce(1).write.partitionBy("level").parquet(f"{path}/tree")


def _tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket int, n bigint, hash string, level int").parquet(f"{path}/tree")


def root(spark: SparkSession, path: str) -> str | None:
    """The hash of a whole saved table, read from one row; None of an empty one."""
    row = _tree(spark, path).where("level = 0").select("hash").first()
    return row and row.hash


def bits_of(spark: SparkSession, path: str) -> int | None:
    return _tree(spark, path).agg(F.max("level")).first()[0]


def differing(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(level, bucket) of the nodes that differ between two saved tables, found from the roots down."""
    sizes = {b for b in (bits_of(spark, old), bits_of(spark, new)) if b is not None}
    if len(sizes) > 1:
        raise ValueError(f"tables with buckets of {sorted(sizes)} bits")
    a, b = _tree(spark, old), _tree(spark, new)
    found, above = None, None
    for level in range(0, max(sizes, default=0) + 1, STEP):
        x, y = (t.where(F.col("level") == level).select("bucket", F.col("hash").alias(n)) for t, n in ((a, "x"), (b, "y")))
        if above is not None:  # children of equal nodes are not met
            x, y = (t.withColumn("up", F.shiftright("bucket", STEP)).join(above, "up", "left_semi").drop("up") for t in (x, y))
        odd = x.join(y, "bucket", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select(F.lit(level).alias("level"), "bucket")
        odd = cut(odd, "differing")  # as many rows as buckets at most
        above = odd.select(F.col("bucket").alias("up"))
        found = odd if found is None else found.unionByName(odd)
    return found


def rows_of(spark: SparkSession, path: str, schema, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a saved table, all or those of some buckets; the others' files are not read."""
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def changes(spark: SparkSession, old: str, new: str, schema) -> DataFrame:
    """(code, change) of the codes that were added, deleted or updated; ``schema`` is that of the saved table with its bucket."""
    tree_of = differing(spark, old, new)
    last = tree_of.agg(F.max("level")).first()[0]
    odd = [] if last is None else sorted(r.bucket for r in tree_of.where(F.col("level") == last).select("bucket").collect())  # 2 ** bits at most
    sides = [rows_of(spark, path, schema, odd).drop("bucket") for path in (old, new)]
    return refresh.diff(*sides).where("change <> 'retained'")


def counts(spark: SparkSession, new: str, changed: DataFrame) -> DataFrame:
    """One row (added, deleted, updated, retained) of :func:`changes`; rows that were not read count as retained by the tree."""
    top = _tree(spark, new).where("level = 0").select("n").first()
    return refresh.diff_counts(changed).withColumn("retained", F.lit(top.n if top else 0).cast("bigint") - F.col("added") - F.col("updated"))
