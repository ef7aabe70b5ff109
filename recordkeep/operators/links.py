"""Links in long form, (code, scope, provider, url), and the policies under which links of two sources meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordkeep.functions.keys import code_prefix, normalize_code
from recordkeep.functions.urls import safe_url, valid_url

LEAF = ["code", "scope", "provider"]
PROVIDERS = ("streamtape", "player4me", "gofile", "subtitle")


def clean_links(links: DataFrame) -> DataFrame:
    """Trimmed addresses, blanks dropped."""
    return links.withColumn("url", F.trim("url")).where("url <> ''")


def overlay(base: DataFrame, incoming: DataFrame, key: list[str] = LEAF, value: str = "url") -> DataFrame:
    """Both sets of leaves; where both have one, the incoming wins."""
    return _both(base, incoming, key, value).select(*key, F.coalesce("_new", "_old").alias(value))


def append_only(previous: DataFrame, incoming: DataFrame, key: list[str] = LEAF, value: str = "url") -> DataFrame:
    """Both sets of leaves; where both have one, the previous stays."""
    return _both(previous, incoming, key, value).select(*key, F.coalesce("_old", "_new").alias(value))


def append_conflicts(previous: DataFrame, incoming: DataFrame, key: list[str] = LEAF, value: str = "url") -> DataFrame:
    """Leaves for which the incoming differs from what stays."""
    return _both(previous, incoming, key, value).where("_old <> _new").select(*key, F.col("_old").alias("kept"), F.col("_new").alias("refused"))


def _both(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    return old.select(*key, F.col(value).alias("_old")).join(new.select(*key, F.col(value).alias("_new")), key, "full_outer")


def keep_verified(links: DataFrame, previous: DataFrame, provider: str = "subtitle") -> DataFrame:
    """The previous links of one provider survive omission and win conflicts."""
    return append_only(previous.where(F.col("provider") == provider), links)


def smallest_wins(links: DataFrame) -> DataFrame:
    """Codes folded to canonical form; of several addresses of a leaf the smallest; all of them as ``seen``.

    One row per leaf says what met, however many addresses those were.
    """
    return _smallest(links.withColumn("code", one_or_none(normalize_code(F.col("code")))), LEAF)


def smallest_group_wins(links: DataFrame) -> DataFrame:
    """The same for links of groups, (prefix, provider, url)."""
    prefix = code_prefix(normalize_code(F.concat("prefix", F.lit("-1"))))
    return _smallest(links.withColumn("prefix", one_or_none(prefix)), ["prefix", "provider"])


def one_or_none(c: Column) -> Column:
    """A generator of the value, or of no row for null. A filter would make Spark compute the value twice."""
    return F.explode(F.array_compact(F.array(c)))


def _smallest(links: DataFrame, key: list[str]) -> DataFrame:
    return clean_links(links).groupBy(*key).agg(F.min("url").alias("url"), F.sort_array(F.collect_set("url")).alias("seen"))


def last_valid(cells: DataFrame, order: str = "row_no") -> DataFrame:
    """Of a sheet's cells (leaf, order, url) the last valid address per leaf."""
    return cells.where(valid_url(F.col("url"))).groupBy(*LEAF).agg(F.max_by("url", order).alias("url"))


def sheet_diagnostics(cells: DataFrame, order: str = "row_no") -> DataFrame:
    """invalid_url, conflict (a change of the running address) and duplicate_code rows of a sheet."""
    filled = cells.where(F.trim("url") != "")
    ok = valid_url(F.col("url"))
    bad = filled.where(~ok).select(F.lit("invalid_url").alias("kind"), "code", F.concat_ws(".", "scope", "provider").alias("field"), F.array("url").alias("values"))
    before = F.lag("url").over(Window.partitionBy(*LEAF).orderBy(order))
    changed = filled.where(ok).withColumn("_before", before).where("_before <> url")
    changed = changed.select(F.lit("conflict").alias("kind"), "code", F.concat_ws(".", "scope", "provider").alias("field"), F.array("_before", "url").alias("values"))
    again = cells.select("code", order).distinct().groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    again = again.select(F.lit("duplicate_code").alias("kind"), "code", F.lit(None).cast("string").alias("field"), F.array(F.col("n").cast("string")).alias("values"))
    return bad.unionByName(changed).unionByName(again)


def inline_links(document: Column) -> Column:
    """A two-level JSON map of links as a sorted list of (scope, provider, url), blanks dropped; null if none is left."""
    as_map = lambda c: F.map_entries(F.from_json(c, "map<string,string>"))
    leaf = lambda scope, e: F.struct(scope.alias("scope"), e["key"].alias("provider"), F.trim(e["value"]).alias("url"))
    nested = lambda e: F.startswith(F.trim(e["value"]), F.lit("{"))
    rows = F.flatten(F.transform(as_map(document), lambda e: F.when(nested(e), F.transform(as_map(e["value"]), lambda x: leaf(e["key"], x))).otherwise(F.array(leaf(F.lit(""), e)))))
    rows = F.array_sort(F.filter(rows, lambda x: x["url"] != ""))
    return F.when(F.size(rows) > 0, rows)


def attach_group_links(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` with the links of each, where it has any, as a map; ``links`` is (prefix, provider, url)."""
    maps = links.groupBy("prefix").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "url")))).alias("links"))
    return groups.join(maps, "prefix", "left")


def link_maps(links: DataFrame) -> DataFrame:
    """(code, links): the links of each code that has any, as a map per scope."""
    own = links.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("scope", "provider", "url"))).alias("m"))  # as many as there are providers and scopes
    of = lambda scope: F.filter("m", lambda x: x["scope"].eqNullSafe(scope))
    urls = lambda scope: F.map_from_entries(F.transform(of(scope), lambda x: F.struct(x["provider"], x["url"])))
    scopes = F.array_distinct(F.transform("m", lambda x: x["scope"]))
    return own.select("code", F.map_from_entries(F.transform(scopes, lambda s: F.struct(s, F.to_json(urls(s))))).alias("links"))


def attach_links(records: DataFrame, links: DataFrame) -> DataFrame:
    """``records`` with their links as a map per scope; links of unknown records are ignored, stale ones replaced."""
    return records.drop("links").join(link_maps(links), "code", "left")


def linked_count(links: DataFrame) -> DataFrame:
    return links.agg(F.count_distinct("code").alias("linked"))


def badges(links: DataFrame, providers: tuple[str, ...] = PROVIDERS) -> DataFrame:
    """Per record and scope the providers with a safe address, in the fixed order of providers."""
    rank = F.array_position(F.array(*map(F.lit, providers)), F.col("provider"))
    shown = links.where(safe_url(F.col("url")).isNotNull() & (rank > 0))
    found = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "provider", safe_url(F.col("url")).alias("url"))))
    return shown.groupBy("code", "scope").agg(found.alias("badges"))
