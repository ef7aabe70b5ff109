"""Meeting of a refresh with the previous snapshot: what stays, what changes, what is new."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordkeep.functions.keys import normalize_code
from recordkeep.functions.text import fingerprint
from recordkeep.functions.urls import PREVIEWS
from recordkeep.functions.values import in_scope

INCREMENTAL, AUDIT, LINKS_ONLY = "incremental", "audit", "links-only"


@dataclass(frozen=True)
class Refresh:
    """Parameters of one refresh."""

    mode: str = INCREMENTAL
    scan_complete: bool = False
    bounded: bool | None = None
    number_from: int | None = None
    number_to: int | None = None
    date_from: str | None = None
    date_to: str | None = None

    @property
    def is_bounded(self) -> bool:
        """Stated, else any bound set."""
        bounds = (self.number_from, self.number_to, self.date_from, self.date_to)
        return any(b is not None for b in bounds) if self.bounded is None else self.bounded

    def scope(self, record_id: Column, date: Column) -> Column:
        return in_scope(record_id, date, self.number_from, self.number_to, self.date_from, self.date_to)


def keyed_union(winning: DataFrame, other: DataFrame, key: str = "code") -> DataFrame:
    """All rows of ``winning``, and those of ``other`` with no such key."""
    return winning.unionByName(other.join(winning.select(key), key, "left_anti"), allowMissingColumns=True)


def retain(incoming: DataFrame, previous: DataFrame | None, how: Refresh, record_id: str = "product_id", date: str = "release_date") -> DataFrame:
    """The records after a refresh.

    Links-only keeps the previous ones. Incremental, and any incomplete scan, adds and replaces. A complete audit
    replaces everything in its bounds; an unbounded one keeps previous records that never had an id. Any other
    complete scan is taken as it is. Without previous records the incoming ones are all there is, whatever the mode.
    """
    if previous is None or ((how.mode == LINKS_ONLY or how.mode == AUDIT) and previous.isEmpty()):
        return incoming
    if how.mode == LINKS_ONLY:
        return previous
    if how.mode == INCREMENTAL or not how.scan_complete:
        return keyed_union(incoming, previous)
    if how.mode == AUDIT and not how.is_bounded:
        return incoming.unionByName(archive_retained(incoming, previous, record_id), allowMissingColumns=True)
    if how.mode == AUDIT:
        inside = how.scope(F.col(record_id), F.col(date))
        return keyed_union(incoming.where(inside), previous.where(~inside))
    return incoming


def archive_retained(incoming: DataFrame, previous: DataFrame, record_id: str = "product_id") -> DataFrame:
    """Previous records without an id that the audit did not bring."""
    return previous.where(F.col(record_id).isNull()).join(incoming.select("code"), "code", "left_anti")


def preserve_precision(records: DataFrame, previous: DataFrame, base: str = "preview_base", count: str = "preview_count") -> DataFrame:
    """A larger known count of the same base is not lost."""
    old = previous.select("code", F.col(base).alias("_base"), F.col(count).alias("_count"))
    better = F.col("_base").eqNullSafe(F.col(base)) & F.col("_base").isNotNull() & (F.col("_count") > F.col(count))
    return records.join(old, "code", "left").withColumn(count, F.when(better, F.col("_count")).otherwise(F.col(count))).drop("_base", "_count")


def backfill_previews(records: DataFrame, derived: Column, count: int = PREVIEWS) -> DataFrame:
    """Records with an id and neither preview field get the derived base and the default count."""
    missing = (F.col("product_id") > 0) & F.col("preview_base").isNull() & F.col("preview_count").isNull() & derived.isNotNull()
    return records.withColumns({"preview_base": F.when(missing, derived).otherwise(F.col("preview_base")), "preview_count": F.when(missing, F.lit(count)).otherwise(F.col("preview_count"))})


def diff(previous: DataFrame, current: DataFrame, links: str | None = None) -> DataFrame:
    """Per code of either side: change (added, deleted, updated, retained), and link_change if ``links`` names a column."""
    skip = ("code",) + ((links,) if links else ())

    def side(df: DataFrame, name: str) -> DataFrame:
        extra = [F.col(links).alias(f"{name}_links")] if links else []
        return df.select("code", fingerprint(df, skip).alias(name), *extra)

    both = side(previous, "old").join(side(current, "new"), "code", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "updated").otherwise("retained")
    out = [F.col("code"), change.alias("change")]
    if links:
        a, b = F.col("old_links"), F.col("new_links")
        out.append(F.when(a.isNull() & b.isNotNull(), "link_added").when(a.isNotNull() & b.isNull(), "link_removed").when(a != b, "link_updated").alias("link_change"))
    return both.select(*out)


def diff_counts(changes: DataFrame) -> DataFrame:
    """One row: added, deleted, updated, retained."""
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "deleted", "updated", "retained")])


def refresh_counts(changes: DataFrame, links: DataFrame, conflicts: DataFrame, supplied: int = 0) -> DataFrame:
    """One row of the nine counters: changes of records and of links, linked records, conflicts met and ``supplied``."""
    of = lambda column, value, name: F.count_if(F.col(column) == value).alias(name)
    own = changes.agg(*[of("change", c, c) for c in ("added", "updated", "retained", "deleted")], *[of("link_change", c, c) for c in ("link_added", "link_updated", "link_removed")])
    linked = links.agg(F.count_distinct("code").alias("linked"))
    met = conflicts.agg((F.count("*") + F.lit(supplied)).alias("link_conflicts"))
    return own.crossJoin(linked).crossJoin(met)  # one row each


def known_split(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``found`` with ``is_known``."""
    marked = known.select(key).distinct().withColumn("_known", F.lit(True))
    return found.join(marked, key, "left").withColumn("is_known", F.coalesce("_known", F.lit(False))).drop("_known")


def resolve_unparsed(cards: DataFrame, details: DataFrame, key: str = "product_id") -> DataFrame:
    """Cards that were not parsed are completed from detail rows; ``resolved`` says whether that worked."""
    cells = [c for c in cards.columns if c != key]
    other = details.select(key, *[F.col(c).alias(f"_{c}") for c in cells if c in details.columns])
    filled = [F.coalesce(c, f"_{c}").alias(c) if c in details.columns else F.col(c) for c in cells]
    return cards.join(other, key, "left").select(key, *filled).withColumn("resolved", F.col("code").isNotNull())


def remapped_ids(previous: DataFrame, current: DataFrame, record_id: str = "product_id") -> DataFrame:
    """Ids that had another code before."""
    old = previous.where(F.col(record_id).isNotNull()).select(record_id, F.col("code").alias("old_code"))
    return current.select(record_id, "code").join(old, record_id).where("code <> old_code")


def lost_rows(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``previous`` that ``current`` does not hold unchanged."""
    return previous.exceptAll(current.select(*previous.columns))


def unequal_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side`` ('left' or 'right'); empty if both are equal as multisets."""
    left, right = a.exceptAll(b.select(*a.columns)), b.select(*a.columns).exceptAll(a)
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))


def filter_incoming(rows: DataFrame, number_from: int | None = None, number_to: int | None = None, date_from: str | None = None) -> DataFrame:
    """Rows in the id range and not before the date floor. One of them with a code that is none ends the run."""
    kept = rows.where(in_scope(F.col("product_id"), F.col("release_date"), number_from, number_to, date_from))
    good = F.when(normalize_code(F.col("code")).isNotNull(), F.col("code"))
    return kept.withColumn("code", F.coalesce(good, F.raise_error(F.concat(F.lit("not a code: "), F.coalesce("code", F.lit("null")))).cast("string")))


def unpublishable(rows: DataFrame, number_from: int | None = None, number_to: int | None = None, date_from: str | None = None) -> DataFrame:
    """The rows for which :func:`filter_incoming` would end the run."""
    return rows.where(in_scope(F.col("product_id"), F.col("release_date"), number_from, number_to, date_from)).where(normalize_code(F.col("code")).isNull())


def candidates(seed: DataFrame, discovered: DataFrame, how: Refresh, has_previous: bool) -> DataFrame:
    """Records that a refresh starts from: the seed alone for links only, with what was found on a first incremental run."""
    if how.mode == LINKS_ONLY:
        return seed
    if how.mode == INCREMENTAL and not has_previous:
        return seed.unionByName(discovered, allowMissingColumns=True)
    return discovered


def canonical_order(rows: DataFrame) -> DataFrame:
    """``rows`` in the order of their fingerprints, for exports."""
    return rows.orderBy(fingerprint(rows))


def directory_and_tail(directory: DataFrame, tail: DataFrame) -> DataFrame:
    """Rows of a listing and of the probes behind it, in canonical order."""
    return canonical_order(directory.unionByName(tail, allowMissingColumns=True))


def known_keys(existing: DataFrame, found: DataFrame) -> DataFrame:
    """(code, prefix) of all records that exist or were found."""
    code = normalize_code(F.col("code"))
    every = existing.select(code.alias("code")).union(found.select(code.alias("code"))).where("code is not null").distinct()
    return every.withColumn("prefix", F.regexp_extract("code", "^(.*)-[^-]*$", 1))


def key_errors(rows: DataFrame, column: str, expected: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """(missing, extra): keys that a map column lacks of ``expected`` or has besides; rows with exactly these drop out."""
    own = F.map_keys(column)
    names = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    found = rows.withColumns({"missing": F.array_sort(F.array_except(names(expected), own)), "extra": F.array_sort(F.array_except(own, names((*expected, *optional))))})
    return found.where((F.size("missing") > 0) | (F.size("extra") > 0) | F.col(column).isNull())
