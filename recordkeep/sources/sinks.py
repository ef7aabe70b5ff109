"""Publishing: snapshot tables in folders of their own, a version created last, hashes, logs and the exported document."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.functions.text import fingerprint
from recordkeep.sources import versions


def row_words(text: Column) -> list[Column]:
    """The eight 32-bit words of a text's SHA-256. Their sums over rows combine before any shuffle."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]


def _sum(word: Column) -> Column:
    """The sum of 32-bit words: their halves are added as longs, which 2^47 rows do not overflow and which cost far less than decimals."""
    high, low = F.sum(F.shiftright(word, 16)), F.sum(word.bitwiseAND(F.lit(0xFFFF)))
    return high.cast("decimal(24,0)") * F.lit(0x10000) + low.cast("decimal(24,0)")


def summed_hash(text: Column) -> Column:
    """An aggregate: a hash of the texts that does not depend on their order; equal texts count."""
    sums = [F.coalesce(_sum(w), F.lit(0)).cast("string") for w in row_words(text)]
    return F.sha2(F.concat_ws(":", F.count(text).cast("string"), *sums), 256)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: a hash of the rows that does not depend on their order."""
    return df.agg(summed_hash(fingerprint(df)).alias("hash"))


def document_lines(records: DataFrame, groups: DataFrame, header: dict) -> DataFrame:
    """The snapshot as ordered JSON lines: the header, then a line per group, latest first.

    Fields stand in the order of their names and nulls are left out, so equal snapshots give equal lines. One line per
    group keeps an export as wide as its largest group, not as the catalogue.
    """
    own = F.struct(*[F.col(c) for c in sorted(c for c in records.columns if c != "prefix")])
    nested = records.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("number", "code", own.alias("r")))).alias("rs"))
    fields = {"code": F.col("prefix"), "count": F.col("n"), "firstReleaseDate": F.col("first_date"), "latestReleaseDate": F.col("latest_date"), "videos": F.transform("rs", lambda x: x["r"])}
    lines = groups.join(nested, "prefix").select(F.struct(F.lit(1).alias("part"), "latest_date", "prefix").alias("place"), F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])).alias("value"))
    first = records.sparkSession.range(1).select(F.to_json(F.struct(*[F.lit(header[k]).alias(k) for k in sorted(header)])).alias("value"))
    top = first.select(F.struct(F.lit(0).alias("part"), F.lit("").alias("latest_date"), F.lit(None).cast(groups.schema["prefix"].dataType).alias("prefix")).alias("place"), "value")
    return top.unionByName(lines).orderBy("place.part", F.desc("place.latest_date"), "place.prefix").select("value")


def publish(spark: SparkSession, root: str, snapshot_id: str, tables: dict[str, DataFrame], violations: DataFrame | None = None, dry_run: bool = False, base: int | None = None) -> bool:
    """All tables in a folder of their own, then the next version; nothing if a gate found anything or on a dry run.

    ``base`` is the version that the refresh started from, the newest unless given: if another refresh has published
    on it meanwhile, :class:`versions.Conflict` is raised and nothing of this one stays. Readers only follow versions,
    so a run that dies half-way leaves no visible trace.
    """
    base = versions.latest(spark, root) if base is None else base
    if violations is not None and not violations.isEmpty():
        return False
    if not dry_run:
        versions.commit(spark, root, base, snapshot_id, tables)
    return True


def current(spark: SparkSession, root: str) -> str | None:
    """Id of the published snapshot."""
    found = versions.latest(spark, root)
    return versions.describe(spark, root, found)["snapshot_id"] if found else None


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return versions.read(spark, root, versions.latest(spark, root), name)


def should_publish(mode: str, authoritative: bool, old_hash: str | None, new_hash: str, old_links: str | None = None, new_links: str | None = None) -> bool:
    """An audit publishes if it is authoritative, other modes if content or link sources changed."""
    return authoritative if mode == "audit" else (old_hash != new_hash or old_links != new_links)


def log_row(counts: DataFrame, snapshot_id: str, mode: str, generated_at: str, inputs: dict[str, str]) -> DataFrame:
    """A refresh-log row: counters, mode and input hashes."""
    cells = F.create_map(*[F.lit(x) for pair in sorted(inputs.items()) for x in pair]) if inputs else F.create_map().cast("map<string,string>")
    return counts.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(mode).alias("mode"), F.lit(generated_at).alias("generated_at"), "*", cells.alias("inputs"))


def append_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").partitionBy("snapshot_id").parquet(path)


def human_summary(log: DataFrame) -> DataFrame:
    """One status line of the latest refresh."""
    latest = log.orderBy(F.desc("generated_at")).limit(1)
    return latest.select(F.format_string("%s: %d added, %d updated, %d retained, %d deleted", "mode", "added", "updated", "retained", "deleted").alias("summary"))


SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"  # and host of a path; both are written in several ways


def write_lines(rows: DataFrame, key: str, path: str) -> None:
    """``rows`` (key, value) as a text file per key in a folder of its own, its lines in order: equal rows give equal files.

    A writer by folder sorts its rows by folder, unless they are; where that sort spills, it keeps no order from before.
    """
    rows.select(key, "value").repartition(key).sortWithinPartitions(key, "value").write.partitionBy(key).text(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, hash) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = re.sub(SCHEME, "", path).rstrip("/")
    own = F.substring_index(F.regexp_replace("path", SCHEME, ""), root + "/", -1)
    return files.select(F.regexp_replace(own, "^/+", "").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def manifest_hash(manifest: DataFrame) -> DataFrame:
    """One row: a hash over paths and file hashes, framed so that no two manifests share a text."""
    return manifest.agg(summed_hash(F.concat(F.length("path").cast("string"), F.lit(":"), F.col("path"), F.lit(":"), F.col("hash"))).alias("hash"))


def compare_manifests(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state) of files that are missing, extra or different."""
    both = expected.select("path", F.col("hash").alias("a")).join(actual.select("path", F.col("hash").alias("b")), "path", "full_outer")
    state = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "different")
    return both.select("path", state.alias("state")).where("state is not null")


def same_release(local: DataFrame, live: DataFrame, commit: tuple[str, ...] = ("commit",)) -> DataFrame:
    """One row (content, exact) of two manifests' headers (field, value): equal but for the commit, and equal as a whole.

    A field that only one of them has is a difference; a manifest without fields equals none.
    """
    both = local.select("field", F.col("value").alias("a"), F.lit(True).alias("x")).join(live.select("field", F.col("value").alias("b"), F.lit(True).alias("y")), "field", "full_outer")
    same = F.col("x").eqNullSafe(F.col("y")) & F.col("a").eqNullSafe(F.col("b"))
    content = F.bool_and(F.when(~F.col("field").isin(*commit), same))
    return both.agg(F.coalesce(content, F.lit(False)).alias("content"), F.coalesce(F.bool_and(same), F.lit(False)).alias("exact"))


def source_summary(sources: DataFrame) -> DataFrame:
    """Per scope: sources, resolved and unresolved ones, and a hash of the addresses."""
    state = lambda name: F.count_if(F.col("state") == name).alias(name)
    return sources.groupBy("scope").agg(F.count("*").alias("n"), state("resolved"), state("unresolved"), summed_hash(F.col("url")).alias("hash"))


def unresolved_sources(sources: DataFrame) -> DataFrame:
    """(scope, prefix, url) of the sources that lead nowhere yet, a row each."""
    return sources.where("state = 'unresolved'").select("scope", "prefix", "url")


def log_codes(changes: DataFrame, snapshot_id: str) -> DataFrame:
    """The code lists of a refresh-log row as rows (snapshot_id, code, change), without those that stay."""
    return changes.where("change <> 'retained'").select(F.lit(snapshot_id).alias("snapshot_id"), "code", "change")
