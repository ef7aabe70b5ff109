"""Quality gates. Each is a query for violating rows, (gate, key, message); a snapshot is publishable if none returns any."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordkeep.functions import keys as keys_of
from recordkeep.functions import text, urls, values
from recordkeep.operators import links as L
from recordkeep.operators import records as C
from recordkeep.operators import refresh as R
from recordkeep.operators import spread

MODES = (R.INCREMENTAL, R.AUDIT, R.LINKS_ONLY)
EARLIEST = "2007-12-07"
LARGEST_SHARE, MOST_DELETED, MOST_DELETED_IN_GROUP = 0.15, 100, 25
COUNTERS = ("added", "deleted", "linkAdded", "linkConflicts", "linkRemoved", "linkUpdated", "linked", "retained", "updated")
SCOPES = {"": ("streamtape", "player4me", "gofile", "subtitle"), "uncensored": ("streamtape", "player4me", "gofile")}


def _bad(df: DataFrame, gate: str, key: Column | str, message: str | Column, where: Column | str | None = None) -> DataFrame:
    df = df if where is None else df.where(where)
    key = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(gate).alias("gate"), key.cast("string").alias("key"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def header(snapshot: DataFrame) -> DataFrame:
    """G1 over one row (schema_version, generated_at, mode)."""
    return union([
        _bad(snapshot, "G1", F.lit("schema_version"), "must be 1", ~F.col("schema_version").eqNullSafe(F.lit(1))),
        _bad(snapshot, "G1", F.lit("generated_at"), "must be a UTC time ending in Z", ~values.valid_instant(F.col("generated_at"))),
        _bad(snapshot, "G1", F.lit("mode"), "unknown refresh mode", ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))),
    ])


def codes(records: DataFrame) -> DataFrame:
    """Code is prefix and number, codes and ids are unique."""
    whole = F.concat(F.col("prefix"), F.lit("-"), F.col("number").cast("string"))
    again = records.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    ids = records.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.sort_array(F.collect_set("code")).alias("codes")).where(F.size("codes") > 1)
    return union([
        _bad(records, "G3", "code", "code, prefix and number differ", ~F.coalesce((whole == F.col("code")) & (F.col("number") >= 0), F.lit(False))),
        _bad(again, "G3", "code", "duplicate code"),
        _bad(records, "G4", "code", "id is not positive", F.col("product_id") <= 0),
        _bad(ids, "G4", "product_id", F.concat(F.lit("duplicate id: "), F.array_join("codes", ", "))),
    ])


def duplicate_ids(records: DataFrame, record_id: str = "product_id", code: str = "code") -> DataFrame:
    """Ids with more than one code, and these."""
    return records.groupBy(record_id).agg(F.sort_array(F.collect_set(code)).alias("codes")).where(F.size("codes") > 1)


def order(groups_in_place: DataFrame | None, records_in_place: DataFrame | None, tags_in_place: DataFrame | None = None) -> DataFrame:
    """Stated places (``place``, counted within the snapshot, and for records within their prefix) follow the order rules.

    Groups stand by latest date, latest first, then by name; those without a date anywhere. Records stand by number and
    code, tags by id, each id once. No task sees all groups, or all of a group.
    """
    parts = []
    if groups_in_place is not None:
        dated = groups_in_place.where(F.col("latest_date").isNotNull())
        now = spread.neighbours(dated, [], ["place"], F.struct(F.col("prefix").alias("prefix"), F.col("latest_date").alias("date")), "_b")
        wrong = (F.col("_b.date") < F.col("latest_date")) | ((F.col("_b.date") == F.col("latest_date")) & (F.col("_b.prefix") > F.col("prefix")))
        parts.append(_bad(now, "G5", "prefix", "group is out of order", wrong))
    if records_in_place is not None:
        parts.append(_bad(C.unsorted(records_in_place, ["prefix"], "place", ["number", "code"]), "G5", "code", "record is out of order"))
    if tags_in_place is not None:
        own = spread.neighbours(tags_in_place.where("id > 0"), [], ["place"], F.struct("id"), "_b")
        parts.append(_bad(own, "G5", "id", "tag is out of order", F.col("_b.id") >= F.col("id")))
    return union(parts)


def texts(records: DataFrame) -> DataFrame:
    """Titles and names are there and undamaged."""
    name_bad = F.exists("actors", lambda a: a.isNull() | (F.trim(a) == "") | text.damaged(a))
    return union([
        _bad(records, "G6", "code", "title is empty", F.coalesce(F.trim("title") == "", F.lit(True))),
        _bad(records, "G6", "code", "title is damaged", text.damaged(F.col("title"))),
        _bad(records, "G6", "code", "names are missing or damaged", F.coalesce(name_bad, F.lit(True))),
    ])


def dates_and_covers(records: DataFrame, earliest: str = EARLIEST) -> DataFrame:
    """G7, G8."""
    return union([
        _bad(records, "G7", "code", "date is not real", ~values.valid_date(F.col("release_date"))),
        _bad(records, "G7", "code", "date is too early", values.valid_date(F.col("release_date")) & (F.col("release_date") < earliest)),
        _bad(records, "G8", "code", "cover is no address", F.col("cover").isNotNull() & ~urls.valid_url(F.col("cover"))),
    ])


def link_shape(links: DataFrame) -> DataFrame:
    """Known scope and provider, valid address."""
    known = F.lit(False)
    for scope, providers in SCOPES.items():
        known = known | ((F.coalesce("scope", F.lit("")) == scope) & F.col("provider").isin(*providers))
    return union([_bad(links, "G9", "code", "unknown scope or provider", ~known), _bad(links, "G9", "code", "invalid address", ~urls.valid_url(F.col("url")))])


def strict_links(records: DataFrame, links: DataFrame, conflicts: int = 0) -> DataFrame:
    """Every record is linked, and nothing met a conflict."""
    bare = _bad(records.join(links.select("code").distinct(), "code", "left_anti"), "G10", "code", "no link")
    return bare if not conflicts else bare.unionByName(_bad(records.sparkSession.range(1), "G10", F.lit("conflicts"), f"{conflicts} conflicts"))


def previews(records: DataFrame, host: str, root: str) -> DataFrame:
    """Base and count come together, the base derives from the cover, the count is 1 to 99."""
    base, count = F.col("preview_base"), F.col("preview_count")
    expanded = [_bad(records, "G11", "code", "expanded addresses must not be published", F.col("preview_urls").isNotNull())] if "preview_urls" in records.columns else []
    return union([
        *expanded,
        _bad(records, "G11", "code", "base and count must come together", base.isNull() != count.isNull()),
        _bad(records, "G11", "code", "base is not official", base.isNotNull() & ~urls.is_preview_base(base, host, root)),
        _bad(records, "G11", "code", "base does not derive from the cover", base.isNotNull() & ~base.eqNullSafe(urls.preview_base(F.col("cover"), host, root))),
        _bad(records, "G11", "code", "count must be 1 to 99", ~count.between(1, 99)),
    ])


def groups(stated: DataFrame, records: DataFrame) -> DataFrame:
    """Stated groups (prefix, n, first_date, latest_date) are those of the records."""
    day = F.when(values.valid_date(F.col("release_date")), F.col("release_date"))
    real = records.groupBy("prefix").agg(F.count("*").alias("_n"), F.min(day).alias("_first"), F.max(day).alias("_latest"))
    both = stated.join(real, "prefix", "full_outer")
    held = stated.join(real.where("_first is not null"), "prefix")  # groups without a real date state none
    return union([
        _bad(stated.groupBy("prefix").agg(F.count("*").alias("m")), "G2", "prefix", "duplicate group", "m > 1"),
        _bad(stated, "G2", "prefix", "invalid group name", ~F.coalesce(F.col("prefix").rlike("^[A-Z0-9]+$"), F.lit(False))),
        _bad(both, "G2", "prefix", "count differs", ~F.col("n").eqNullSafe(F.col("_n"))),
        _bad(held, "G12", "prefix", "first date differs", ~F.col("first_date").eqNullSafe(F.col("_first"))),
        _bad(held, "G12", "prefix", "latest date differs", ~F.col("latest_date").eqNullSafe(F.col("_latest"))),
    ])


def not_empty(records: DataFrame) -> DataFrame:
    return _bad(records.agg(F.count("*").alias("n")), "G2", F.lit("snapshot"), "is empty", "n = 0")


def group_links(links: DataFrame) -> DataFrame:
    """Groups have only a subtitle link to a shared file or folder."""
    good = (F.col("provider") == "subtitle") & (urls.destination(F.col("url")) == "drive")
    return _bad(links, "G13", "prefix", "only a direct subtitle link is allowed", ~F.coalesce(good, F.lit(False)))


def resources(rows: DataFrame, label: str, name: str = "subtitleDirectory") -> DataFrame:
    """(name, fields): the only resource has exactly a label, which is fixed, and a valid address."""
    exact = F.array_sort(F.map_keys("fields")) == F.array(F.lit("label"), F.lit("url"))
    get = lambda k: F.element_at("fields", F.lit(k))
    return union([
        _bad(rows, "G13", "name", "unknown resource", ~F.col("name").eqNullSafe(F.lit(name))),
        _bad(rows, "G13", "name", "must hold label and url alone", ~F.coalesce(exact, F.lit(False))),
        _bad(rows, "G13", "name", "label is wrong", ~get("label").eqNullSafe(F.lit(label))),
        _bad(rows, "G13", "name", "invalid address", ~urls.valid_url(get("url"))),
    ])


def tag_gates(records: DataFrame, definitions: DataFrame, stated: DataFrame | None = None, required: bool = False) -> DataFrame:
    """Definitions (id, group, name, translation) are whole and unique; ids of records are sorted, unique and known.

    With ``stated`` (id, n) every definition has a count, none below zero, and it is the observed one. Where tags are
    required, records have ids, if only none, and status, time and one of two provenances. A definition whose id is not
    positive counts as none. Places of definitions are held to G5.
    """
    from recordkeep.operators import tags as T

    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    ids = F.coalesce("tag_ids", F.array().cast("array<bigint>"))
    pairs = records.select("code", F.explode("tag_ids").alias("tag_id"))
    known = definitions.where("id > 0")
    parts = [
        _bad(records, "G14", "code", "tag ids must be unique and sorted", ~F.array_sort(F.array_distinct(ids)).eqNullSafe(ids) | F.exists(ids, lambda x: x.isNull())),
        _bad(T.unknown_tags(pairs, known), "G14", "code", F.concat(F.lit("unknown tag "), F.col("tag_id").cast("string"))),
        _bad(definitions, "G14", "id", "id must be positive", ~F.coalesce(F.col("id") > 0, F.lit(False))),
        _bad(known.groupBy("id").agg(F.count("*").alias("n")), "G14", "id", "duplicate tag", "n > 1"),
        _bad(known, "G14", "id", "unknown group", ~F.coalesce(F.col("group").isin(*T.TAG_GROUPS), F.lit(False))),
        _bad(known, "G14", "id", "both names are needed", blank("name") | blank("translation")),
    ]
    if stated is not None:
        counted = known.select("id").distinct().join(stated.select("id", F.col("n").alias("stated")), "id", "left")
        parts.append(_bad(counted, "G14", "id", "count must be stated and not negative", ~F.coalesce(F.col("stated") >= 0, F.lit(False))))
        parts.append(_bad(T.stated_counts_differ(T.tag_counts(pairs, known.select("id").distinct()), stated), "G14", "id", "count differs"))
    if required:
        need = {
            "status must be complete": F.col("tags_status") == "complete",
            "time must be a UTC time ending in Z": values.valid_instant(F.col("tags_updated_at")),
            "provenance must be official": F.col("tags_source").isin(*C.TAG_SOURCES),
            "tag ids are missing": F.col("tag_ids").isNotNull(),
        }
        parts += [_bad(records, "G14", "code", message, ~F.coalesce(good, F.lit(False))) for message, good in need.items()]
    if "place" in definitions.columns:
        parts.append(order(None, None, definitions))
    return union(parts)


def totals(actual: DataFrame, stated: DataFrame) -> DataFrame:
    """Two one-row tables of counters must agree."""
    names = [c for c in stated.columns if c in actual.columns]
    both = actual.select(*[F.col(c).alias(f"_{c}") for c in names]).crossJoin(stated.select(*names))  # one row each
    return union([_bad(both, "G15", F.lit(c), F.concat(F.lit("expected "), F.col(f"_{c}").cast("string")), ~F.col(c).eqNullSafe(F.col(f"_{c}"))) for c in names])


def counters(row: DataFrame) -> DataFrame:
    """Added + updated + retained = records."""
    return _bad(row, "G16", F.lit("counts"), "added, updated and retained do not sum up", F.col("added") + F.col("updated") + F.col("retained") != F.col("records"))


def refresh_block(blocks: DataFrame, mode: str, complete: bool | None, expected: DataFrame | None = None) -> DataFrame:
    """G16 over rows (key, mode, source_complete, counts map, inputs map) against what the run was asked and what it did.

    ``expected`` is one row of counters by their exported names, as far as they can be recomputed.
    """
    counts = F.col("counts")
    get = lambda name: F.element_at(counts, F.lit(name))
    negative = F.map_filter(counts, lambda _, v: v.isNull() | (v < 0))
    digest = F.map_filter("inputs", lambda k, v: (k == "") | v.isNull() | ~v.rlike("^[0-9a-f]{64}$"))
    listed = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ", ")
    keys = R.key_errors(blocks, "counts", COUNTERS)
    parts = [
        _bad(blocks, "G16", "key", "unknown refresh mode", ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))),
        _bad(blocks, "G16", "key", F.concat(F.lit("mode is not "), F.lit(mode)), F.col("mode").isin(*MODES) & (F.col("mode") != mode)),
        _bad(blocks, "G16", "key", "completeness is not stated", F.col("source_complete").isNull()),
        _bad(keys, "G16", "key", F.concat(F.lit("counters missing: "), F.array_join("missing", ", ")), F.size("missing") > 0),
        _bad(keys, "G16", "key", F.concat(F.lit("counters unknown: "), F.array_join("extra", ", ")), F.size("extra") > 0),
        _bad(blocks, "G16", "key", F.concat(F.lit("counters not a count: "), listed(negative)), F.size(negative) > 0),
        _bad(blocks, "G16", "key", F.concat(F.lit("inputs are no SHA-256: "), listed(digest)), F.size(digest) > 0),
    ]
    if complete is not None:
        parts.append(_bad(blocks, "G16", "key", F.lit(f"completeness is not {str(complete).lower()}"), F.col("source_complete") != complete))
    if expected is not None:
        both = blocks.crossJoin(expected.select(*[F.col(c).alias(f"_{c}") for c in expected.columns]))  # one row of counters
        names = [c for c in expected.columns if c in COUNTERS]
        parts += [_bad(both, "G16", "key", F.concat(F.lit(f"{c} is not "), F.col(f"_{c}").cast("string")), get(c) != F.col(f"_{c}")) for c in names]
        if "records" in expected.columns:
            parts.append(_bad(both, "G16", "key", "added, updated and retained do not sum up", get("added") + get("updated") + get("retained") != F.col("_records")))
    return union(parts)


def hashes(inputs: DataFrame) -> DataFrame:
    """(name, hash) are SHA-256 in lower-case hex."""
    return _bad(inputs, "G16", "name", "is no SHA-256", ~F.coalesce(F.col("hash").rlike("^[0-9a-f]{64}$"), F.lit(False)))


def manifest_files(files: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """(path, hash): safe paths, each once, with a SHA-256, and the required ones among them."""
    again = files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    parts = [paths(files), _bad(files, "G29", "path", "is no SHA-256", ~F.coalesce(F.col("hash").rlike("^[0-9a-f]{64}$"), F.lit(False))), _bad(again, "G29", "path", "repeated path")]
    if required:
        wanted = files.sparkSession.createDataFrame([(p,) for p in required], "path string")
        parts.append(_bad(wanted.join(files.select("path"), "path", "left_anti"), "G29", "path", "required file is missing"))
    return union(parts)


def manifest_totals(manifest: DataFrame, keys: tuple[str, ...], actual: DataFrame) -> DataFrame:
    """One-row manifests (key, fields map) have exactly ``keys``, version 1 and the recomputed ``hash`` of ``actual``."""
    wrong = R.key_errors(manifest, "fields", keys)
    get = lambda k: F.element_at("fields", F.lit(k))
    both = manifest.crossJoin(actual.select(F.col("hash").alias("_hash")))  # one row
    return union([
        _bad(wrong, "G29", "key", "missing or unexpected fields"),
        _bad(manifest, "G29", "key", "unexpected version", ~get("schemaVersion").eqNullSafe(F.lit("1"))),
        _bad(both, "G29", "key", "hash does not match the files", ~get("hash").eqNullSafe(F.col("_hash"))),
    ])


def link_manifest(sources: DataFrame) -> DataFrame:
    """G23 over (state, scope, prefix, code, url): canonical names, valid addresses, no source twice, states disjoint by group.

    ``code`` is set for links of records alone. Resolved and unresolved sources and child sheets share no group.
    """
    prefix, code = keys_of.normalize_prefix(F.col("prefix")), keys_of.normalize_code(F.col("code"))
    again = sources.groupBy("state", "scope", "prefix", "code").agg(F.count("*").alias("n")).where("n > 1")
    groups_of = sources.where(F.col("code").isNull())
    return union([
        _bad(sources, "G23", "prefix", "group name is not canonical", ~prefix.eqNullSafe(F.col("prefix"))),
        _bad(sources, "G23", "code", "code is not canonical", F.col("code").isNotNull() & ~code.eqNullSafe(F.col("code"))),
        _bad(sources, "G23", "prefix", "code is of another group", keys_of.code_prefix(code) != F.col("prefix")),
        _bad(sources, "G23", "prefix", "resolved source is no shared file", (F.col("state") == "resolved") & (urls.destination(F.col("url")) != "drive")),
        _bad(sources, "G23", "prefix", "invalid address", ~urls.valid_url(F.col("url"))),
        _bad(again, "G23", F.coalesce("code", "prefix"), "repeated source"),
        disjoint({s: groups_of.where(F.col("state") == s) for s in ("resolved", "unresolved", "child")}),
    ])


def paths(files: DataFrame) -> DataFrame:
    """Paths are relative and stay inside."""
    safe = F.col("path").rlike(r"^[^/\\]") & ~F.col("path").rlike(r"(^|/)\.\.?(/|$)") & ~F.contains("path", F.lit("\\"))
    return _bad(files, "G29", "path", "unsafe path", ~F.coalesce(safe, F.lit(False)))


def remapped(previous: DataFrame, current: DataFrame) -> DataFrame:
    """G17."""
    return _bad(R.remapped_ids(previous, current), "G17", "product_id", F.concat(F.lit("was "), F.col("old_code")))


def deletions(changes: DataFrame, how: R.Refresh, previous: DataFrame | None = None) -> DataFrame:
    """G18, G19, G20 over (code, change)."""
    deleted = F.col("change") == "deleted"
    if how.mode == R.INCREMENTAL:
        return _bad(changes, "G18", "code", "an incremental refresh deletes nothing", deleted)
    if how.mode == R.LINKS_ONLY:
        return _bad(changes, "G19", "code", "a links-only refresh changes no record", F.col("change") != "retained")
    gone = changes.where(deleted)
    if not how.scan_complete:
        return _bad(gone, "G20", "code", "deleted without a complete scan")
    if how.is_bounded and previous is not None:
        outside = gone.join(previous.select("code", "product_id", "release_date"), "code").where(~how.scope(F.col("product_id"), F.col("release_date")))
        return _bad(outside, "G20", "code", "deleted outside the bounds")
    return _bad(gone, "G20", "code", "", F.lit(False))


def regression(previous: DataFrame, current: DataFrame, group: str = "prefix", share: float = LARGEST_SHARE, most: int = MOST_DELETED, most_in_group: int = MOST_DELETED_IN_GROUP) -> DataFrame:
    """G21, in one pass: previous and deleted records per group and (group null) in all, and whether limits are broken.

    Both limits hold for every group alike: one record deleted of a group of six is more than 15 %.
    """
    marked = previous.select("code", group).join(current.select("code", F.lit(1).alias("_here")), "code", "left")
    sums = marked.rollup(group).agg(F.count("*").alias("before"), F.count_if(F.col("_here").isNull()).alias("deleted"), F.grouping(group).alias("whole"))
    sums = sums.withColumn("share", F.col("deleted") / F.col("before"))
    limit = F.when(F.col("whole") == 1, most).otherwise(most_in_group)
    return sums.withColumn("broken", (F.col("share") > share) | (F.col("deleted") > limit))


def header_errors(cells: list[str], first: str = "NEW CODE", divider: str = "UNCENSORED", providers: tuple[str, ...] = ()) -> list[str]:
    """Faults of a link sheet's header row."""
    out = [f"{name}: {cells.count(name)} columns" for name in (first, divider) if cells.count(name) != 1]
    if out:
        return out
    a, b = cells.index(first), cells.index(divider)
    if a >= b:
        return [f"{first} must stand before {divider}"]
    return [f"{p}: {part.count(p)} columns {side} {divider}" for side, part in (("before", cells[a + 1 : b]), ("behind", cells[b + 1 :])) for p in providers if part.count(p) != 1]


def sheet_headers(sheets: DataFrame, first: str = "NEW CODE", divider: str = "UNCENSORED", providers: tuple[str, ...] = ()) -> DataFrame:
    """G27 over the header rows (sheet, cells) of many sheets: what :func:`header_errors` says of each."""
    cells = F.col("cells")
    count = lambda c, name: F.size(F.filter(c, lambda x: x == name))
    whole = (count(cells, first) == 1) & (count(cells, divider) == 1)
    at, middle = F.array_position(cells, first).cast("int"), F.array_position(cells, divider).cast("int")
    ordered = whole & (at < middle)
    before, behind = F.slice(cells, at + 1, F.greatest(middle - at - 1, F.lit(0))), F.slice(cells, middle + 1, F.size(cells))
    many = lambda c, name, tail: F.concat(F.lit(f"{name}: "), count(c, name).cast("string"), F.lit(f" columns{tail}"))
    parts = [_bad(sheets, "G27", "sheet", many(cells, n, ""), count(cells, n) != 1) for n in (first, divider)]
    parts.append(_bad(sheets, "G27", "sheet", f"{first} must stand before {divider}", whole & (at >= middle)))
    for name in providers:
        parts += [_bad(sheets, "G27", "sheet", many(part, name, f" {side} {divider}"), ordered & (count(part, name) != 1)) for side, part in (("before", before), ("behind", behind))]
    return union(parts)


def disjoint(names: dict[str, DataFrame], key: str = "prefix") -> DataFrame:
    """No key stands in two of the sets."""
    tagged = union([df.select(key).distinct().withColumn("_set", F.lit(n)) for n, df in names.items()])
    return _bad(tagged.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("_set")), ", ").alias("sets"), F.count("*").alias("n")), "G23", key, F.concat(F.lit("in "), F.col("sets")), "n > 1")


def continuity(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """What was resolved before is still there, unchanged."""
    return _bad(R.lost_rows(previous, current), "G24", key, "changed or lost")


def membership(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys exist in the catalogue."""
    return _bad(rows.join(known.select(key).distinct(), key, "left_anti"), "G23", key, "not in the catalogue")


def sources(pages: DataFrame, host: str, path: str, tab: str | None = None) -> DataFrame:
    """Landed (source_url, body) come from the very document (host, path, tab) that is expected, and are text, not markup."""
    url = F.col("source_url")
    right = (urls.part(url, "PROTOCOL") == "https") & (urls.part(url, "HOST") == host) & (urls.part(url, "PATH") == path)
    if tab is not None:
        right = right & (urls.query_values(url, "gid") == F.array(F.lit(tab)))
    return union([
        _bad(pages, "G28", "source_url", "unexpected source", ~F.coalesce(right, F.lit(False))),
        _bad(pages, "G28", "source_url", "is markup", F.col("body").rlike(r"(?i)^\s*<(!doctype html|html|head|body)")),
    ])


def listing(pages: DataFrame) -> DataFrame:
    """Pages that do not add up."""
    return _bad(pages, "G25", "page", "cards and records differ", ~F.col("complete"))


def scan(summary: DataFrame, mode: str = R.INCREMENTAL) -> DataFrame:
    """A summary (see ``scans.scan_summary``) that contradicts itself.

    Counts are there and not negative, the cursor is over 0, and the mode, where one is stated, is the one asked for.
    Errors and the reason ``error`` go together; without errors parsed = new + known, the ``records`` that came, where
    stated, are the parsed ones of an audit and the new ones else, an empty page is the last of at least one, and only
    an incremental scan may end on known pages, of which there are two at least.
    """
    key, reason, errors = F.lit("scan"), F.col("stop_reason"), F.col("errors")
    known = ["empty", "all_known", "page_limit", "error"] if mode == R.INCREMENTAL else ["empty", "page_limit", "error"]
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) >= 0, F.lit(False)) for c in ("pages", "parsed", "new", "known", "errors", "retries") if c in summary.columns])
    clean = errors == 0
    parts = [
        _bad(summary, "G26", key, "a count is missing or negative", ~whole),
        _bad(summary, "G26", key, "cursor must be over 0", ~F.coalesce(F.col("cursor") > 0, F.lit(False))),
        _bad(summary, "G26", key, "unknown reason to stop", ~F.coalesce(reason.isin(known), F.lit(False))),
        _bad(summary, "G26", key, "errors and reason to stop differ", ~(errors > 0).eqNullSafe(reason == "error")),
        _bad(summary, "G26", key, "numbers do not add up", clean & ~F.col("parsed").eqNullSafe(F.col("new") + F.col("known"))),
        _bad(summary, "G26", key, "did not end where it says", clean & (((reason == "empty") & ~((F.col("pages") >= 1) & (F.col("cursor") == F.col("pages")))) | ((reason == "all_known") & (F.col("pages") < 2)))),
    ]
    if "mode" in summary.columns:
        parts.append(_bad(summary, "G26", key, "another mode", ~F.col("mode").eqNullSafe(F.lit(mode))))
    if "records" in summary.columns:
        expected = F.col("parsed") if mode == R.AUDIT else F.col("new")
        parts.append(_bad(summary, "G26", key, "another number of records came", clean & ~F.col("records").eqNullSafe(expected)))
    return union(parts)


@dataclass
class Snapshot:
    """What the gates can be held to; what is absent is not checked, but records and stated groups always are."""

    records: DataFrame
    groups: DataFrame
    header: DataFrame | None = None
    links: DataFrame | None = None
    group_links: DataFrame | None = None
    definitions: DataFrame | None = None
    stated_tags: DataFrame | None = None
    stated_totals: DataFrame | None = None
    refresh: DataFrame | None = None
    inputs: DataFrame | None = None
    group_places: DataFrame | None = None
    record_places: DataFrame | None = None
    resources: DataFrame | None = None


def all_violations(now: Snapshot, previous: DataFrame | None = None, how: R.Refresh = R.Refresh(), earliest: str = EARLIEST, host: str = "www.example.com", root: str = "db", strict: bool = False, require_tags: bool = False, conflicts: int = 0, label: str = "") -> DataFrame:
    """All gates of a snapshot and of its predecessor in one table; G22 is this without a predecessor.

    Deletion limits (G21) hold for complete audits, as no other refresh may delete at all.
    """
    records = now.records
    parts = [not_empty(records), codes(records), texts(records), dates_and_covers(records, earliest), groups(now.groups, records)]
    add = parts.append
    if now.header is not None:
        add(header(now.header))
    if now.group_places is not None or now.record_places is not None:
        add(order(now.group_places, now.record_places))
    if now.links is not None:
        add(link_shape(now.links))
        if strict:
            add(strict_links(records, now.links, conflicts))
        if now.stated_totals is not None:
            add(totals(C.totals(records, now.links), now.stated_totals))
    if now.group_links is not None:
        add(group_links(now.group_links))
    if now.resources is not None:
        add(resources(now.resources, label))
    if {"preview_base", "preview_count"} <= set(records.columns):
        add(previews(records, host, root))
    if now.definitions is not None:
        add(tag_gates(records, now.definitions, now.stated_tags, require_tags))
    if now.refresh is not None:
        add(refresh_block(now.refresh, how.mode, how.scan_complete))
    if now.inputs is not None:
        add(hashes(now.inputs))
    if previous is not None:
        changes = R.diff(previous, records)
        parts += [remapped(previous, records), deletions(changes, how, previous)]
        if how.mode == R.AUDIT and how.scan_complete:
            add(_bad(regression(previous, records).where("broken"), "G21", F.coalesce("prefix", F.lit("all")), F.concat(F.col("deleted").cast("string"), F.lit(" deleted"))))
    return union(parts).distinct()


def violations(records: DataFrame, stated_groups: DataFrame, links: DataFrame | None = None, previous: DataFrame | None = None, how: R.Refresh = R.Refresh(), earliest: str = EARLIEST) -> DataFrame:
    """:func:`all_violations` of records, their groups and, if given, links and the previous records."""
    return all_violations(Snapshot(records, stated_groups, links=links), previous, how, earliest)


def accepted_baseline(records: DataFrame, stated_groups: DataFrame, earliest: str = EARLIEST) -> DataFrame:
    """The previous records, if they pass the gates themselves; an invalid baseline is refused."""
    found = violations(records, stated_groups, earliest=earliest).limit(5).collect()
    if found:
        raise ValueError("the baseline is invalid: " + "; ".join(f"{r.gate} {r.key}: {r.message}" for r in found))
    return records


LINK_LEAF = L.LEAF
