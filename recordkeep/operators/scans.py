"""Scans of listing pages: what is new, where a scan may end, and whether pages add up.

The only window without partitions runs over a bounded series of probes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_seen_page(cards: DataFrame, page: str = "page", key: str = "product_id") -> DataFrame:
    return cards.groupBy(key).agg(F.min(page).alias("first_page"))


def page_novelty(cards: DataFrame, known: DataFrame, page: str = "page", key: str = "product_id", fetched: DataFrame | None = None) -> DataFrame:
    """Per page the number of ids that no earlier page and no known record has.

    ``fetched`` lists the pages that were landed; those without a card are in the result as well.
    """
    fresh = first_seen_page(cards.where(F.col(key).isNotNull()), page, key).join(known.select(key).distinct(), key, "left_anti")
    n = fresh.groupBy(F.col("first_page").alias(page)).agg(F.count("*").alias("new"))
    pages = (cards if fetched is None else fetched).select(page).distinct()
    return pages.join(n, page, "left").select(page, F.coalesce("new", F.lit(0)).alias("new"))


def scan_stop(pages: DataFrame, mode: str = "incremental", page: str = "page") -> DataFrame:
    """One row (cutoff, stop_reason) over page facts (page, cards, new, complete).

    A scan ends at the first page that does not add up (error), has no cards (empty) or, in incremental mode only, is
    the second in a row without anything new (all_known); a scan that meets none of these ran into its page limit.
    """
    known = pages.where((F.col("new") == 0) & (F.col("cards") > 0) & F.col("complete"))
    again = known.join(known.select((F.col(page) + 1).alias(page)), page, "left_semi").select(page, F.lit("all_known").alias("why"))
    ends = pages.select(page, F.when(~F.col("complete"), "error").when(F.col("cards") == 0, "empty").alias("why")).where("why is not null")
    ends = ends.unionByName(again) if mode == "incremental" else ends
    found = ends.agg(F.min(page).alias("cutoff"), F.min_by("why", page).alias("why"))
    return found.select("cutoff", F.coalesce("why", F.lit("page_limit")).alias("stop_reason"))


def incremental_cutoff(novelty: DataFrame, page: str = "page") -> DataFrame:
    """One row: the first page that, like the page numbered one lower, brought nothing new; null if there is none."""
    empty = novelty.where("new = 0").select(page)
    before = empty.select((F.col(page) + 1).alias(page))
    return empty.join(before, page, "left_semi").agg(F.min(page).alias("cutoff"))


def tail_cutoff(probes: DataFrame, misses: int = 3, most: int | None = 25, order: str = "probe", outcome: str = "outcome", by: str | None = None) -> DataFrame:
    """The probe of the ``misses``-th miss in a row; hits and errors start the count again; at most ``most`` probes count.

    One row for a single series of probes, which ``most`` must bound; with ``by`` one row for each of many series.
    """
    if by is None:
        if most is None:
            raise ValueError("a single series needs a bound")
        probes = probes.orderBy(order).limit(most)
    key = [] if by is None else [by]
    in_order = Window.partitionBy(*key).orderBy(order)
    if by is not None and most is not None:
        probes = probes.withColumn("_at", F.row_number().over(in_order)).where(F.col("_at") <= most)
    island = F.sum(F.when(F.col(outcome) == "miss", 0).otherwise(1)).over(in_order)
    run = probes.withColumn("_island", island).where(F.col(outcome) == "miss")
    placed = run.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_island").orderBy(order)))
    found = placed.where(F.col("_n") == misses).groupBy(*key).agg(F.min(order).alias("cutoff"))
    return found if by is None else probes.select(by).distinct().join(found, by, "left")


def page_reconciliation(cards: DataFrame, page: str = "page", key: str = "product_id") -> DataFrame:
    """Per page: cards, distinct resolved ids, unidentifiable, unresolved, duplicates, and whether it adds up."""
    out = cards.groupBy(page).agg(
        F.count("*").alias("cards"),
        F.count_distinct(F.when(F.col("parsed"), F.col(key))).alias("resolved"),
        F.count_if(F.col(key).isNull()).alias("unidentifiable"),
        F.count_if(F.col(key).isNotNull() & ~F.col("parsed")).alias("unresolved"),
        (F.count(key) - F.count_distinct(key)).alias("duplicates"),
    )
    return out.withColumn("complete", (F.col("cards") == F.col("resolved")) & (F.col("unidentifiable") == 0) & (F.col("unresolved") == 0) & (F.col("duplicates") == 0))


def duplicate_cards(cards: DataFrame, page: str = "page", key: str = "product_id") -> DataFrame:
    """(page, key) of ids that stand twice on a page or on an earlier one as well."""
    per_page = cards.where(F.col(key).isNotNull()).groupBy(page, key).agg(F.count("*").alias("n"))
    first = F.min(page).over(Window.partitionBy(key))
    return per_page.withColumn("_first", first).where((F.col("n") > 1) | (F.col(page) > F.col("_first"))).select(page, key)


def scan_summary(pages: DataFrame, mode: str = "incremental", page: str = "page") -> DataFrame:
    """One row over page facts (page, cards, resolved, complete, new): what a scan saw up to where it stopped."""
    seen = pages.crossJoin(scan_stop(pages, mode, page)).where(F.col("cutoff").isNull() | (F.col(page) <= F.col("cutoff")))  # one row beside the pages
    counted = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return seen.agg(
        F.count("*").alias("pages"),
        counted("cards").alias("cards"),
        counted("resolved").alias("parsed"),
        counted("new").alias("new"),
        (counted("resolved") - counted("new")).alias("known"),
        F.count_if(~F.col("complete")).alias("errors"),
        F.coalesce(F.max("cutoff"), F.max(page)).alias("cursor"),
        F.max("stop_reason").alias("stop_reason"),
    )


def scan_authoritative(pages: DataFrame, audit: bool, ended_empty: bool) -> DataFrame:
    """One row: an audit that ended on an empty page and whose pages all add up."""
    return pages.agg((F.lit(audit and ended_empty) & F.coalesce(F.bool_and("complete"), F.lit(True))).alias("authoritative"))
