"""Substring search without reading every record: posting lists of character trigrams, intersected, then verified.

A record that holds a needle holds all its trigrams. The index has a row for each trigram and record. These rows are many
times the text, so they are never moved: each block of records writes its own list, sorted by trigram, and a search reads
the pages of a few trigrams from each; which ones are rarest is in a table of counts. What all of them share are
candidates. Records lie in buckets by hash of the code; only the buckets of candidates are read, and ``contains`` decides,
so the index never changes a result, only what is read for it.

Needles of fewer than three characters, and those whose rarest trigram stands in more than ``SCAN`` of all records, are
searched by the scan, which is then cheaper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordkeep.operators.browse import Catalog, contains, needle
from recordkeep.plans.lineage import cut

GRAM = 3
#: Trigrams of a needle that are intersected, the rarest ones; the others are left to the verification.
MOST = 6
#: Share of the records above which a posting list is not worth reading.
SCAN = 0.1
BUCKETS = 64
#: Records of a block; its codes fit one dictionary of a file and its postings the memory of a task.
BLOCK = 20_000


def grams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substring(text, i, GRAM)))).otherwise(F.array().cast("array<string>"))


def _bucket(code: Column) -> Column:
    return F.pmod(F.xxhash64(code), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """A written index of a catalogue; :meth:`search` gives what the catalogue's own search gives."""

    def __init__(self, spark: SparkSession, path: str, schema, total: int):
        self.spark, self.path, self.schema, self.total = spark, path, schema, total

    @classmethod
    def write(cls, catalog: Catalog, path: str) -> SearchIndex:
        """Write records, posting lists and counts under ``path``."""
        rows = catalog.searchable().join(catalog.groups.select("prefix", "latest_date"), "prefix")
        spark, own = rows.sparkSession, rows.withColumn("bucket", _bucket(F.col("code")))
        own.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "code").write.partitionBy("bucket").parquet(f"{path}/records")
        index = cls(spark, path, own.schema, 0)
        index.total = index.records().count()
        blocks = index.records().select("code", "bucket", "haystack").repartition(max(1, -(-index.total // BLOCK)), "code")
        blocks.select(F.explode(grams(F.col("haystack"))).alias("gram"), "code", "bucket").sortWithinPartitions("gram", "code").write.parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
        return index

    def records(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/records")

    def plan(self, query: str) -> list[str] | None:
        """The trigrams that a search intersects; None where it scans, empty where a trigram of the needle stands nowhere."""
        wanted = needle(query)
        own = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
        if not own:
            return None
        known = {r.gram: r.n for r in self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(own)).collect()}  # as many as the needle has
        if len(known) < len(own):
            return []
        rarest = sorted(own, key=lambda g: (known[g], g))
        return None if known[rarest[0]] > SCAN * self.total else [g for g in rarest[:MOST] if known[g] <= 10 * known[rarest[0]] + 1000]

    def candidates(self, chosen: list[str]) -> DataFrame:
        """(code, bucket) of the records that hold all the chosen trigrams."""
        hits = self.spark.read.parquet(f"{self.path}/postings").where(F.col("gram").isin(chosen))
        return hits.groupBy("code", "bucket").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(chosen)).select("code", "bucket")

    def matches(self, query: str) -> DataFrame:
        """Records that hold the query, verified, in no order."""
        wanted, chosen = needle(query), self.plan(query)
        rows = self.records()
        if not wanted or chosen == []:
            rows = rows.where(F.lit(False))
        elif chosen is not None:
            found = cut(self.candidates(chosen), "candidates")
            held = [r.bucket for r in found.select("bucket").distinct().collect()]  # BUCKETS at most
            rows = rows.where(F.col("bucket").isin(held)).join(found.select("code"), "code", "left_semi")
        return contains(rows, "haystack", wanted)

    def search(self, query: str) -> DataFrame:
        """Like :meth:`Catalog.search`: latest group first, of records with one code the first."""
        place = [F.desc("latest_date"), F.col("prefix"), F.col("number"), F.col("code")]
        first = self.matches(query).withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(*place))).where("_n = 1")
        return first.orderBy(*place).drop("latest_date", "haystack", "bucket", "_n")
