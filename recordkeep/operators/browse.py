"""Browse queries over a snapshot: search, filters, lookups, orders and favourites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordkeep.functions.keys import code_of
from recordkeep.functions.text import normal_of, normalize_text
from recordkeep.operators import links as L
from recordkeep.operators import records as R
from recordkeep.operators import spread
from recordkeep.operators import tags as T
from recordkeep.operators.spread import placed  # noqa: F401  part of this interface
from recordkeep.plans.lineage import cut


def haystack(columns: list[Column], normal=normalize_text) -> Column:
    """What a search looks into."""
    return normal(F.concat_ws(" ", *columns))


def needle(query: str) -> str:
    """The canonical code of a query if it is one, else its search form; '' for a blank one."""
    return normal_of(code_of(query) or query)


def contains(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows whose search form holds ``wanted``; none for a blank one."""
    return rows.where(F.contains(column, F.lit(wanted)) if wanted else F.lit(False))


def filter_by_tags(records: DataFrame, include: list[int], exclude: list[int] = (), match: str = "all", ids: str = "tag_ids") -> DataFrame:
    """Records without any of ``exclude``, and with all (or any) of ``include``; an empty ``include`` passes."""
    own = F.coalesce(ids, F.array().cast("array<bigint>"))
    want = sorted({i for i in include if isinstance(i, int) and not isinstance(i, bool) and i > 0})
    bad = sorted({i for i in exclude if isinstance(i, int) and not isinstance(i, bool) and i > 0})
    as_array = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    if bad:
        records = records.where(~F.arrays_overlap(own, as_array(bad)))
    if want and match == "any":
        records = records.where(F.arrays_overlap(own, as_array(want)))
    elif want:
        records = records.where(F.size(F.array_except(as_array(want), own)) == 0)
    return records


def codes_by_tags(assignments: DataFrame, include: list[int], exclude: list[int] = (), match: str = "all") -> DataFrame:
    """The same over the (code, tag_id) bridge: only the rows of the named tags are read and moved."""
    want = sorted(set(include))
    hits = assignments.where(F.col("tag_id").isin(want)).select("code", "tag_id").distinct().groupBy("code").agg(F.count("*").alias("n"))
    found = hits.where(F.col("n") >= (1 if match == "any" else len(want))).select("code")
    if exclude:
        found = found.join(assignments.where(F.col("tag_id").isin(list(exclude))).select("code").distinct(), "code", "left_anti")
    return found


def newest(date: str = "release_date", code: str = "code") -> list[Column]:
    return [F.desc_nulls_last(date), F.desc(code)]


def oldest(date: str = "release_date", code: str = "code") -> list[Column]:
    return [F.asc_nulls_first(date), F.asc(code)]


def natural(prefix: str = "prefix", number: str = "number") -> list[Column]:
    return [F.asc(prefix), F.asc(number)]


def favourites(state: DataFrame, records: DataFrame) -> DataFrame:
    """Marked records (states 1 and 2) by state and code; marks of missing records drop out."""
    return state.where(F.col("state").isin(1, 2)).join(records, "code").orderBy("state", "code")


def covers_accepted(manifest: DataFrame, records: DataFrame, path: Column) -> DataFrame:
    """Manifest entries (code, path) whose path is the one that follows from the record."""
    return manifest.join(records.select("code", path.alias("_path")), "code").where("path = _path").drop("_path")


@dataclass
class Catalog:
    """A snapshot's tables; every query is a DataFrame."""

    records: DataFrame
    groups: DataFrame
    tags: DataFrame
    links: DataFrame
    refresh_log: DataFrame | None = None

    def searchable(self) -> DataFrame:
        """Records with their search form; worth writing once per snapshot."""
        names = self.records.select("code", F.explode("tag_ids").alias("id")).join(self.tags.select("id", F.concat_ws(" ", "translation", "name").alias("_n")), "id")
        names = names.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("_n")), " ").alias("_tags"))
        own = self.records.join(names, "code", "left")
        return own.withColumn("haystack", haystack([F.col("code"), F.col("title"), F.array_join("actors", " "), F.col("prefix"), F.col("_tags")])).drop("_tags")

    def search(self, query: str) -> DataFrame:
        """Records whose search form holds the query, latest group first; of records with one code the first."""
        found = contains(self.searchable(), "haystack", needle(query)).join(self.groups.select("prefix", "latest_date"), "prefix")
        place = [F.desc("latest_date"), F.col("prefix"), F.col("number"), F.col("code")]
        first = found.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(*place))).where("_n = 1")
        return first.orderBy(*place).drop("latest_date", "haystack", "_n")

    def search_tags(self, query: str, group: str | None = None) -> DataFrame:
        """Tags, of one group or all, whose names hold the query; none for a blank one."""
        wanted = normal_of(query)
        rows = self.tags if group is None else self.get_tags(group)
        return contains(rows.withColumn("_h", haystack([F.col("translation"), F.col("name")])), "_h", wanted).drop("_h")

    def get_record(self, code: str) -> DataFrame:
        return self.records.where(F.col("code") == F.lit(code_of(code)))

    def get_group(self, prefix: str) -> DataFrame:
        return self.groups.where(F.col("prefix") == prefix.strip().upper())

    def get_tag(self, tag_id: int) -> DataFrame:
        return self.tags.where(F.col("id") == tag_id)

    def get_tags(self, group: str) -> DataFrame:
        return self.tags.where(F.col("group") == group)

    def recent_groups(self, k: int | None = None) -> DataFrame:
        return R.recent_groups(self.groups, k)

    def group_view(self, prefix: str, with_gaps: bool = False) -> DataFrame:
        own = self.records.where(F.col("prefix") == prefix.strip().upper())
        return R.slots(own).orderBy("number") if with_gaps else own.orderBy("number", "code")

    def group_page(self, prefix: str, start: int = 0, limit: int | None = None, with_gaps: bool = False, total: int | None = None) -> tuple[DataFrame, dict]:
        """One page of a group's view, and where it lies. Of slots only those of the page are spelled out."""
        if not with_gaps:
            return R.page(self.group_view(prefix), ["number", "code"], start, limit, total)
        runs = cut(spread.slot_runs(self.records.where(F.col("prefix") == prefix.strip().upper())), "slot-runs")
        size = spread.slot_sizes(runs).first()
        place = spread.window(size.total if size else 0, start, limit)
        low = place["start"] + (0 if size and size.zero else 1)
        return spread.slot_range(runs, low, low + place["end"] - place["start"] - 1).orderBy("number"), place

    def favourites_page(self, marks: DataFrame, state: int, start: int = 0, limit: int | None = None) -> tuple[DataFrame, dict]:
        """One page of the records marked with one state."""
        return R.page(favourites(marks.where(F.col("state") == state), self.records), ["code"], start, limit)

    def detail(self, code: str) -> DataFrame:
        """The record, its tags by group and its link badges per scope."""
        own = self.get_record(code)
        shown = L.badges(self.links.join(own.select("code"), "code", "left_semi")).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("scope", "badges"))).alias("link_groups"))
        tags = T.tags_by_group(own, self.tags).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("group", "tags"))).alias("tag_groups"))
        return own.join(tags, "code", "left").join(shown, "code", "left")

    def metadata(self) -> DataFrame:
        """The latest row of the refresh log."""
        return self.refresh_log.orderBy(F.desc("generated_at")).limit(1)

