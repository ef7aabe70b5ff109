"""Order without a task per group: neighbours, runs of slots and pages, for groups of any size.

Rows are sorted over range partitions, so a group that holds a third of all rows lies in as many pieces as it fills.
Rows are compared inside their piece; what meets across pieces are rims, one row a piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordkeep.plans.lineage import cut, session_dir


def placed(rows: DataFrame, order: list[Column], free: bool = False, codec: str | None = None) -> DataFrame:
    """``rows`` with their ``place`` in the whole order, from 1, without one task seeing all rows.

    Rows are sorted over range partitions; a partition's places start behind the rows of those before it. ``free`` and
    ``codec`` are those of the cut behind the sort.
    """
    part = cut(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "placed", free, codec)
    own = F.shiftright("_id", 33)
    sizes = part.groupBy(own.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    joined = part.withColumn("_part", own).join(F.broadcast(before), "_part")
    return joined.withColumn("place", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_id")


def neighbours(rows: DataFrame, partition: list[str], place: list[str | Column], value: Column, name: str = "before") -> DataFrame:
    """``rows`` with the ``value`` of the row before them in their partition, null for the first; as ``lag`` over a window gives it.

    ``value`` should not be null itself: use a struct.
    """
    own = [F.col(f"`{c}`") for c in rows.columns]
    part = rows.select(F.struct(*own).alias("_row"), value.alias("_value"), *[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(partition)], *[(F.col(p) if isinstance(p, str) else p).alias(f"_o{i}") for i, p in enumerate(place)])
    keys, order = [f"_g{i}" for i in range(len(partition))], [f"_o{i}" for i in range(len(place))]
    part = cut(part.orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id()), "neighbours").withColumn("_part", F.shiftright("_id", 33))
    inside = part.withColumn("_before", F.lag("_value").over(Window.partitionBy("_part", *keys).orderBy("_id")))
    rims = part.groupBy("_part", *keys).agg(F.max_by("_value", "_id").alias("_last"), F.min("_id").alias("_first"))
    rims = rims.select("_first", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_rim"))  # a row a piece
    joined = inside.join(rims.where("_rim is not null").withColumnRenamed("_first", "_id"), "_id", "left")
    return joined.select("_row.*", F.coalesce("_before", "_rim").alias(name))


def running(rows: DataFrame, partition: list[str], place: list[str | Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before them in their partition, 0 for the first."""
    own = [F.col(f"`{c}`") for c in rows.columns]
    part = rows.select(F.struct(*own).alias("_row"), value.cast("bigint").alias("_value"), *[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(partition)], *[(F.col(p) if isinstance(p, str) else p).alias(f"_o{i}") for i, p in enumerate(place)])
    keys, order = [f"_g{i}" for i in range(len(partition))], [f"_o{i}" for i in range(len(place))]
    part = cut(part.orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id()), "running").withColumn("_part", F.shiftright("_id", 33))
    before = lambda w: F.coalesce(F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = part.withColumn("_inside", before(Window.partitionBy("_part", *keys).orderBy("_id"))).withColumn("_piece", F.min("_id").over(Window.partitionBy("_part", *keys)))
    pieces = part.groupBy("_part", *keys).agg(F.sum("_value").alias("_value"), F.min("_id").alias("_piece"))
    pieces = pieces.select("_piece", before(Window.partitionBy(*keys).orderBy("_part")).alias("_ahead"))  # a row a piece
    return inside.join(pieces, "_piece").select("_row.*", (F.col("_inside") + F.col("_ahead")).alias(name))


def unsorted(rows: DataFrame, partition: list[str], place: str, order: list[str]) -> DataFrame:
    """Rows whose stated place contradicts the order of their columns."""
    now = F.struct(*[F.col(c) for c in order])
    return neighbours(rows, partition, [place], now, "_before").where(F.col("_before") > now).drop("_before")


# --- slots -------------------------------------------------------------------------------------------------------------


def slot_runs(records: DataFrame, group: str = "prefix", least: int = 99) -> DataFrame:
    """The slot view of each group as runs (group, first, last, code, gap): a record a row, a gap a row however wide.

    Numbers go from 1 to the largest, ``least`` at least. Of several records of a number the first by code is shown, and
    so is one of number 0, before all others. Records without a number (null, or the largest long) are not shown, but
    their group is, empty if it has no others.
    """
    none = F.lit(2**63 - 1)
    shown = records.where((F.col("number") >= 0) & (F.col("number") < none)).groupBy(group, "number").agg(F.min("code").alias("code"))
    shown = cut(shown, "slots")
    filled = shown.select(group, F.col("number").alias("first"), F.col("number").alias("last"), "code", F.lit(False).alias("gap"))
    before = neighbours(shown.where("number > 0").select(group, "number"), [group], ["number"], F.struct("number"))
    blank, yes = F.lit(None).cast("string").alias("code"), F.lit(True).alias("gap")
    inner = before.select(group, (F.coalesce(F.col("before.number"), F.lit(0)) + 1).alias("first"), (F.col("number") - 1).alias("last"), blank, yes).where("first <= last")
    reach = records.groupBy(group).agg(F.coalesce(F.max(F.when((F.col("number") > 0) & (F.col("number") < none), F.col("number"))), F.lit(0)).alias("reach"))
    tail = reach.where(F.col("reach") < least).select(group, (F.col("reach") + 1).alias("first"), F.lit(least).cast("bigint").alias("last"), blank, yes)
    return filled.unionByName(inner).unionByName(tail)


def slot_sizes(runs: DataFrame, group: str = "prefix") -> DataFrame:
    """(group, zero, total): whether there is a slot 0, and the number of slots."""
    return runs.groupBy(group).agg(F.bool_or(F.col("first") == 0).alias("zero"), (F.max("last") + F.bool_or(F.col("first") == 0).cast("bigint")).alias("total"))


def slot_range(runs: DataFrame, low: int, high: int, group: str = "prefix") -> DataFrame:
    """(group, number, code, gap) of the slots from ``low`` to ``high``: only these are spelled out."""
    hit = runs.where((F.col("last") >= low) & (F.col("first") <= high))
    numbers = F.sequence(F.greatest("first", F.lit(low).cast("bigint")), F.least("last", F.lit(high).cast("bigint")))
    return hit.select(group, F.explode(numbers).alias("number"), "code", "gap")


def slots(records: DataFrame, group: str = "prefix", least: int = 99) -> DataFrame:
    """All slots of :func:`slot_runs` spelled out (group, number, code, gap), for groups whose numbers are dense."""
    none = F.lit(2**63 - 1)
    shown = records.where((F.col("number") >= 0) & (F.col("number") < none)).groupBy(group, "number").agg(F.min("code").alias("code"))
    reach = records.groupBy(group).agg(F.greatest(F.lit(least).cast("bigint"), F.max(F.when(F.col("number") < none, F.col("number")))).alias("reach"))
    frame = reach.select(group, F.explode(F.sequence(F.lit(1).cast("bigint"), "reach")).alias("number"))
    filled = frame.join(shown.where("number > 0"), [group, "number"], "left").select(group, "number", "code", F.col("code").isNull().alias("gap"))
    return filled.unionByName(shown.where("number = 0").select(group, "number", "code", F.lit(False).alias("gap")))


# --- pages -------------------------------------------------------------------------------------------------------------


def window(total: int, start: int = 0, limit: int | None = None, most: int = 100, whole: int = 250) -> dict:
    """Where one page lies in ``total`` rows: up to ``whole`` rows make a single one unless a limit is given, of more none exceeds ``most``."""
    start = min(max(0, start), total)
    if total > whole:
        size = min(limit if limit is not None and limit > 0 else most, most)
    else:
        size = total if limit is None or limit < 0 else limit
    end = min(start + size, total)
    return {"start": start, "end": end, "size": size, "total": total, "previous": max(0, start - size) if start else None, "next": end if end < total else None}


class Pages:
    """An ordered table written once, from which a page reads the chunks it lies in and nothing before them.

    Rows are sorted over range partitions, placed, and written by chunks of ``chunk`` places; the first row of each
    chunk is kept beside them. Rows that tie in the order keep one place each.
    """

    def __init__(self, spark: SparkSession, path: str, chunk: int, total: int, schema):
        self.spark, self.path, self.chunk, self.total, self.schema = spark, path, chunk, total, schema

    @classmethod
    def write(cls, rows: DataFrame, order: list[Column], chunk: int = 10_000, path: str | None = None) -> Pages:
        spark = rows.sparkSession
        path = path or f"{session_dir(spark)}/pages-{uuid.uuid4().hex}"
        own = placed(rows, order).withColumn("chunk", F.floor((F.col("place") - 1) / chunk).cast("bigint"))
        own.repartition("chunk").sortWithinPartitions("chunk", "place").write.partitionBy("chunk").parquet(f"{path}/rows")
        written = spark.read.schema(own.schema).parquet(f"{path}/rows")
        names = [c for c in own.columns if c not in ("chunk", "place")]
        edges = written.groupBy("chunk").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), "place").alias("first"), F.count("*").alias("n"))
        edges.coalesce(1).write.parquet(f"{path}/edges")
        total = spark.read.parquet(f"{path}/edges").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return cls(spark, path, chunk, total, own.schema)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def page(self, start: int = 0, limit: int | None = None, most: int = 100, whole: int = 250) -> tuple[DataFrame, dict]:
        """The rows of one page in order, and where it lies."""
        place = window(self.total, start, limit, most, whole)
        first, last = place["start"] + 1, place["end"]
        chunks = range((first - 1) // self.chunk, max(last - 1, 0) // self.chunk + 1)
        hit = self._rows().where(F.col("chunk").between(chunks.start, chunks.stop - 1) & F.col("place").between(first, last))
        return hit.orderBy("place").drop("chunk", "place"), place

    def after(self, beyond: Column, n: int) -> DataFrame:
        """The first ``n`` rows for which ``beyond`` holds, which says that a row lies behind the last one seen in the order.

        The chunk that holds the seam is found from the first rows of the chunks, of which there is one a chunk.
        """
        edges = self.spark.read.parquet(f"{self.path}/edges").select("chunk", "first.*")
        before = edges.where(~F.coalesce(beyond, F.lit(False))).agg(F.coalesce(F.max("chunk"), F.lit(0)).alias("c")).first().c
        reach = before + 1 + -(-n // self.chunk)
        hit = self._rows().where(F.col("chunk").between(before, reach) & F.coalesce(beyond, F.lit(False)))
        return hit.orderBy("place").limit(n).drop("chunk", "place")
