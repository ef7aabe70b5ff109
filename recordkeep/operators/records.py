"""Records: canonical form, one winner per code, groups, totals, order, pages and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordkeep.functions import keys, text, urls, values
from recordkeep.operators import spread
from recordkeep.operators.links import inline_links

OPTIONAL = {
    "title": "string", "actors": "array<string>", "releaseDate": "string", "date": "string", "cover": "string", "series": "string", "number": "string", "productId": "string",
    "previewBase": "string", "previewCount": "string", "tagIds": "array<bigint>", "tagsStatus": "string", "tagsUpdatedAt": "string", "tagsSource": "string", "links": "string",
}
TAG_SOURCES = ("official", "official-unavailable")


def canonical_records(raw: DataFrame) -> DataFrame:
    """``raw`` (code and any of OPTIONAL) -> records with ``reject_reason``, null for good ones."""
    have = {c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast(t) for c, t in OPTIONAL.items()}
    code = keys.normalize_code(F.col("code"))
    named = raw.select("*", code.alias("_code"))
    prefix, number = keys.code_prefix(F.col("_code")), keys.code_number(F.col("_code"))
    reason = (
        F.when(F.col("_code").isNull(), "invalid_code")
        .when(have["series"].isNotNull() & (have["series"] != prefix), "series_mismatch")
        .when(have["number"].isNotNull() & ~F.coalesce(have["number"].try_cast("bigint") == number, F.lit(False)), "number_mismatch")
    )
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return named.select(
        F.col("_code").alias("code"),
        prefix.alias("prefix"),
        number.alias("number"),
        have["title"].alias("title"),
        F.coalesce(have["actors"], F.array().cast("array<string>")).alias("actors"),
        F.coalesce(have["releaseDate"], have["date"]).alias("release_date"),
        have["cover"].alias("cover"),
        values.positive_int(have["productId"]).alias("product_id"),
        F.when(F.trim(have["previewBase"]) != "", have["previewBase"]).alias("preview_base"),
        values.positive_int(have["previewCount"]).cast("int").alias("preview_count"),
        values.clean_ids(have["tagIds"]).alias("tag_ids"),
        filled(have["tagsStatus"]).alias("tags_status"),
        filled(have["tagsUpdatedAt"]).alias("tags_updated_at"),
        F.when(have["tagsSource"].isin(*TAG_SOURCES), have["tagsSource"]).alias("tags_source"),
        inline_links(have["links"]).alias("links"),
        reason.alias("reject_reason"),
    )


def quality(record_id: Column, date: Column, cover: Column, actors: Column, title: Column) -> Column:
    """What makes one candidate better than another, as a comparable struct."""
    has_actor = F.exists(F.coalesce(actors, F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    clean_title = F.coalesce((F.trim(title) != "") & ~text.damaged(title), F.lit(False))
    return F.struct(record_id.isNotNull(), values.valid_date(date), urls.valid_url(cover), F.coalesce(has_actor, F.lit(False)), clean_title)


def ranked(candidates: DataFrame, key: list[str], best_first: list[Column]) -> DataFrame:
    """``candidates`` with ``place`` among those of their key, 1 for the best."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*best_first)))


def winners(candidates: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The candidate with the largest ``order`` per key, by a map-side aggregation that no hot key can overload."""
    row = F.struct(*[F.col(f"`{c}`") for c in candidates.columns])
    return candidates.groupBy(*key).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def select_records(candidates: DataFrame) -> DataFrame:
    """Good canonical records -> one per code; equal quality is settled by the fingerprint."""
    return winners(candidates, ["code"], F.struct(quality(F.col("product_id"), F.col("release_date"), F.col("cover"), F.col("actors"), F.col("title")), text.fingerprint(candidates)))


def discarded(candidates: DataFrame) -> DataFrame:
    """Diagnostics of the records that lost against another of their code."""
    marked = candidates.withColumn("_print", text.fingerprint(candidates)).withColumn("_quality", quality(F.col("product_id"), F.col("release_date"), F.col("cover"), F.col("actors"), F.col("title")))
    lost = ranked(marked, ["code"], [F.desc("_quality"), F.desc("_print")]).where("place > 1")
    return lost.select(F.lit("discarded_duplicate").alias("kind"), "code", F.col("_print").alias("detail"))


def build_groups(records: DataFrame, group: str = "prefix", date: str = "release_date") -> DataFrame:
    """Per group: n, first and latest date (a missing date counts as '')."""
    day = F.coalesce(F.col(date), F.lit(""))
    return records.groupBy(group).agg(F.count("*").alias("n"), F.min(day).alias("first_date"), F.max(day).alias("latest_date"))


def nested_groups(records: DataFrame) -> DataFrame:
    """Groups with their children as an ordered array, for export."""
    day = F.coalesce(F.col("release_date"), F.lit(""))
    child = F.struct("number", "code", *[c for c in records.columns if c not in ("number", "code", "prefix")])
    return records.groupBy("prefix").agg(F.count("*").alias("count"), F.min(day).alias("firstReleaseDate"), F.max(day).alias("latestReleaseDate"), F.array_sort(F.collect_list(child)).alias("records"))


def in_group_order(groups: DataFrame, group: str = "prefix") -> DataFrame:
    return groups.orderBy(F.desc("latest_date"), group)


def recent_groups(groups: DataFrame, k: int | None, group: str = "prefix") -> DataFrame:
    """The k latest groups: all without k, none for a k that is no positive count."""
    out = in_group_order(groups, group)
    return out if k is None else out.limit(max(0, k))


def totals(records: DataFrame, links: DataFrame, group: str = "prefix") -> DataFrame:
    """One row: groups, records, linked records."""
    linked = links.select("code").distinct().withColumn("_linked", F.lit(1))
    joined = records.select("code", group).join(linked, "code", "left")
    return joined.agg(F.count_distinct(group).alias("groups"), F.count("*").alias("records"), F.count("_linked").alias("linked"))


def unsorted(records: DataFrame, partition: list[str], place: str, order: list[str]) -> DataFrame:
    """Rows whose stated place contradicts the order of their columns, whatever the size of a partition."""
    return spread.unsorted(records, partition, place, order)


def page(rows: DataFrame, order: list, start: int = 0, limit: int | None = None, total: int | None = None, window: int = 100, whole: int = 250) -> tuple[DataFrame, dict]:
    """One window of ordered rows, and where it lies; :class:`spread.Pages` for many pages of one order.

    Up to ``whole`` rows make a single page unless a limit is given; of more, a page is never larger than ``window``.
    A start past the end gives no rows. ``total`` saves a count where the snapshot's log already has it.
    """
    place = spread.window(rows.count() if total is None else total, start, limit, window, whole)
    return rows.orderBy(*order).offset(place["start"]).limit(place["size"]), place


def featured(records: DataFrame, groups: DataFrame, eligible: Column, k: int = 6) -> DataFrame:
    """The first k eligible records, by number and code, of the latest group."""
    latest = in_group_order(groups).limit(1).select("prefix")
    return records.join(latest, "prefix", "left_semi").where(eligible).orderBy("number", "code").limit(k)


def slots(records: DataFrame, group: str = "prefix", least: int = 99) -> DataFrame:
    """Per group a row for every number from 1 to max(least, largest), number 0 before them; gaps have no code.

    See :func:`spread.slot_runs`, which does not spell gaps out.
    """
    return spread.slots(records, group, least)


def contiguous_prefix(rows: DataFrame, key: str, index: str) -> DataFrame:
    """Per key the largest n such that 1..n all occur."""
    seen = rows.where(F.col(index) >= 1).select(key, F.col(index).alias("_i")).distinct()
    placed = seen.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_i")))
    kept = placed.groupBy(key).agg(F.count_if(F.col("_i") == F.col("_n")).alias("n"))
    return rows.select(key).distinct().join(kept, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
