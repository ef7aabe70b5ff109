"""Tags: definitions, counts, names, assignments, and which records to look up next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordkeep.functions.text import collapse
from recordkeep.functions.values import clean_ids, positive_int, valid_instant

TAG_FIELDS = ["tag_ids", "tags_status", "tags_updated_at", "tags_source"]
TAG_GROUPS = ("genre", "character")
#: Findings of one code and kind that are spelled out at once.
PIECE = 10_000


def filled(c: Column) -> Column:
    """The trimmed text, null for a blank one."""
    return F.when(F.trim(c) != "", F.trim(c))


def tag_counts(assignments: DataFrame, definitions: DataFrame) -> DataFrame:
    """``definitions`` with the number of distinct records per tag, zero where there are none."""
    n = assignments.select("tag_id", "code").distinct().groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("n"))
    return definitions.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def unknown_tags(assignments: DataFrame, definitions: DataFrame) -> DataFrame:
    """Assignments of tags without a definition."""
    return assignments.join(definitions.select(F.col("id").alias("tag_id")), "tag_id", "left_anti")


def conflicting_definitions(definitions: DataFrame) -> DataFrame:
    """Ids that are defined with different groups or source names."""
    return definitions.groupBy("id").agg(F.count_distinct(F.struct("group", "name")).alias("n")).where("n > 1").select("id")


def normalize_definitions(definitions: DataFrame, order: str = "seq", reviewed: DataFrame | None = None, groups: tuple[str, ...] = TAG_GROUPS) -> DataFrame:
    """One row per positive id with a known group and a name: id, group, name, translation, source; names are collapsed.

    A reviewed translation (name, translation) wins, else the last definition's, else the name itself. ``source`` says
    which: reviewed, what the definition says, official for the name itself, else machine. An id that is defined with
    two groups or names ends the run; :func:`conflicting_definitions` lists such ids.
    """
    good = definitions.withColumns({"id": positive_int(F.col("id")), "name": collapse(F.col("name"))}).where(F.col("group").isin(*groups) & (F.col("name") != "") & F.col("id").isNotNull())
    own = filled(collapse(F.col("translation")))
    said = filled(collapse(F.col("source"))) if "source" in definitions.columns else F.lit(None).cast("string")
    last = good.groupBy("id").agg(
        F.count_distinct("group", "name").alias("_n"), F.min("group").alias("group"), F.min("name").alias("name"), F.max_by(own, order).alias("_own"), F.max_by(said, order).alias("_said")
    )
    other = F.lit(None).cast("string")
    if reviewed is not None:
        last = last.join(reviewed.select(collapse(F.col("name")).alias("name"), filled(collapse(F.col("translation"))).alias("_reviewed")), "name", "left")
        other = F.col("_reviewed")
    translation = F.coalesce(other, "_own", "name")
    source = F.when(other.isNotNull(), "reviewed").otherwise(F.coalesce("_said", F.when(translation == F.col("name"), "official").otherwise("machine")))
    checked = F.when(F.col("_n") == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("conflicting tag definition: "), F.col("id").cast("string"))).cast("string"))
    return last.select("id", "group", checked.alias("name"), translation.alias("translation"), source.alias("source"))


def first_definitions(definitions: DataFrame, order: str = "seq", groups: tuple[str, ...] = TAG_GROUPS) -> DataFrame:
    """One row per id, its first valid definition, names trimmed; the browse side reads definitions this way.

    Valid are positive ids of a known group with both names. A ``count`` that is none reads as 0.
    """
    names = {c: F.trim(c) for c in ("name", "translation")}
    good = definitions.withColumns({"id": positive_int(F.col("id")), **names}).where(F.col("id").isNotNull() & F.col("group").isin(*groups) & (F.col("name") != "") & (F.col("translation") != ""))
    if "count" in definitions.columns:
        good = good.withColumn("count", F.when(F.col("count") >= 0, F.col("count")).otherwise(0))
    return good.groupBy("id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in good.columns]), order).alias("_row")).select("_row.*")


def merge_definitions(directory: DataFrame, stored: DataFrame) -> DataFrame:
    """All ids of both; the directory's row is taken whole."""
    return directory.unionByName(stored.join(directory.select("id"), "id", "left_anti"))


def resolve_names(definitions: DataFrame, reviewed: DataFrame, stored: DataFrame, cached: DataFrame) -> DataFrame:
    """``definitions`` (id, name) with translation and its source: reviewed by name, stored if the name is unchanged, cached by id, else ``needed``.

    Blank reviewed and stored translations count as none.
    """
    found = (
        definitions.withColumn("name", F.trim("name"))
        .join(reviewed.select("name", filled(F.col("translation")).alias("_r")), "name", "left")
        .join(stored.select("id", F.col("name").alias("_sname"), filled(F.col("translation")).alias("_s")), "id", "left")
        .join(cached.select("id", F.trim("translation").alias("_c")), "id", "left")
    )
    kept = F.when(F.col("_sname") == F.col("name"), F.col("_s"))
    source = F.when(F.col("_r").isNotNull(), "reviewed").when(kept.isNotNull(), "stored").when(F.col("_c").isNotNull(), "cached").otherwise("needed")
    return found.select("id", "name", F.coalesce("_r", kept, "_c").alias("translation"), source.alias("source"))


def detail_mismatches(records: DataFrame, details: DataFrame, record_id: str = "product_id") -> DataFrame:
    """(code, found): details that were fetched by a record's id and name another code."""
    own = records.where(F.col(record_id).isNotNull()).select(record_id, "code")
    return own.join(details.select(record_id, F.col("code").alias("found")), record_id).where(~F.col("code").eqNullSafe(F.col("found"))).select("code", "found")


def apply_details(records: DataFrame, details: DataFrame, now: str) -> DataFrame:
    """Fields that a detail row has replace the record's; tags are replaced, with status, time and provenance.

    Only details of the record's own code apply; others are an error, see :func:`detail_mismatches`.
    """
    cells = [c for c in records.columns if c != "code" and c not in TAG_FIELDS]
    other = details.select("code", *[(F.col(c) if c in details.columns else F.lit(None)).alias(f"_{c}") for c in [*cells, "tag_ids"]], F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    out = [F.coalesce(f"_{c}", c).alias(c) for c in cells]
    tags = {"tag_ids": F.coalesce(clean_ids(F.col("_tag_ids")), F.array().cast("array<bigint>")), "tags_status": F.lit("complete"), "tags_updated_at": F.lit(now), "tags_source": F.lit("official")}
    return records.join(other, "code", "left").select("code", *out, *[F.when(hit, v).otherwise(F.col(c)).alias(c) for c, v in tags.items()])


def apply_id_overrides(records: DataFrame, overrides: DataFrame, record_id: str = "product_id") -> DataFrame:
    """Ids that are missing or not positive filled from reviewed ones (code, id)."""
    return records.join(overrides.select("code", positive_int(F.col("id")).alias("_id")), "code", "left").withColumn(record_id, F.coalesce(positive_int(F.col(record_id)), "_id", record_id)).drop("_id")


def override_errors(records: DataFrame, overrides: DataFrame, record_id: str = "product_id") -> DataFrame:
    """(kind, code): overrides that are no positive id, contradict the record, or name no record."""
    joined = overrides.join(records.select("code", F.col(record_id).alias("_own"), F.lit(True).alias("_hit")), "code", "left")
    kind = F.when(positive_int(F.col("id")).isNull(), "invalid_id").when(F.col("_hit").isNull(), "unknown_code").when(positive_int(F.col("_own")) != positive_int(F.col("id")), "conflict")
    return joined.select(kind.alias("kind"), "code").where("kind is not null")


def mark_unavailable(records: DataFrame, now: str, record_id: str = "product_id") -> DataFrame:
    """Records without an id cannot be looked up: no tags, complete, and an older readable time stays."""
    lost = F.col(record_id).isNull()
    new = {"tag_ids": F.array().cast("array<bigint>"), "tags_status": F.lit("complete"), "tags_updated_at": F.when(valid_instant(F.col("tags_updated_at")), F.col("tags_updated_at")).otherwise(F.lit(now)), "tags_source": F.lit("official-unavailable")}
    return records.withColumns({c: F.when(lost, v).otherwise(F.col(c)) for c, v in new.items()})


def sync_targets(records: DataFrame, now: str, stale_days: int = 90, full: bool = False, k: int | None = None) -> DataFrame:
    """Records to look up: incomplete ones (``urgency`` 0) by id and code, then stale ones (1) by time and id; ``full`` makes all urgent.

    A time that is missing or cannot be read is stale.
    """
    cutoff = F.to_timestamp(F.lit(now)) - F.expr(f"interval {max(stale_days, 0)} days")
    updated = F.try_to_timestamp(F.when(valid_instant(F.col("tags_updated_at")), F.col("tags_updated_at")))
    urgent = F.lit(full) | ~F.col("tags_status").eqNullSafe(F.lit("complete"))
    urgency = F.when(urgent, 0).when(updated.isNull() | (updated < cutoff), 1)
    found = records.where(F.col("product_id") > 0).withColumn("urgency", urgency).where("urgency is not null")
    time = F.when(F.col("urgency") == 0, "").otherwise(F.coalesce("tags_updated_at", F.lit("")))
    ordered = found.orderBy("urgency", time, "product_id", "code")
    return ordered if k is None else ordered.limit(max(k, 0))


def split_runtime(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(core, assignments): records without tag fields, and non-empty tag lists by code."""
    return records.drop(*TAG_FIELDS), records.where(F.size("tag_ids") > 0).select("code", "tag_ids")


def hydrate(core: DataFrame, assignments: DataFrame) -> DataFrame:
    """Core records with their tag lists back; none is an empty list."""
    return core.join(assignments, "code", "left").withColumn("tag_ids", F.coalesce("tag_ids", F.array().cast("array<bigint>")))


def generation_errors(core: DataFrame, payload: DataFrame) -> DataFrame:
    """(kind, key) if two one-row headers (schema_version, generated_at) are not of one generation."""
    both = core.select(F.col("generated_at").alias("_g")).crossJoin(payload.select("schema_version", "generated_at"))  # one row each
    wrong = F.when(~F.col("schema_version").eqNullSafe(F.lit(1)), "schema_version").when(~F.col("generated_at").eqNullSafe(F.col("_g")), "generation")
    return both.select(wrong.alias("kind"), F.col("generated_at").alias("key")).where("kind is not null")


def hydrate_errors(core: DataFrame, assignments: DataFrame, definitions: DataFrame) -> DataFrame:
    """(kind, key) of all that forbids to hydrate.

    Codes that repeat in the core; assignments that repeat, name unknown codes, are empty, repeat a tag or name an
    unknown one; definitions that repeat or have no positive id; and, where they state ``n``, counts that differ.

    The codes of both sides are counted in one grouping, tags in another, so no table is joined or sent whole to say
    what is wrong with it.
    """
    found = lambda df, kind, key="code": df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"))
    repeated = lambda df, key: df.groupBy(key).count().where("count > 1")
    empty, doubled = F.coalesce(F.size("tag_ids"), F.lit(0)) <= 0, F.coalesce(F.size("tag_ids") != F.size(F.array_distinct("tag_ids")), F.lit(False))
    marks = {"_core": F.lit(0), "_lists": F.lit(1), "_empty": empty.cast("int"), "_doubled": doubled.cast("int")}
    both = assignments.select("code", *[c.alias(name) for name, c in marks.items()]).unionByName(core.select("code", *[F.lit(int(name == "_core")).alias(name) for name in marks]))
    per = both.groupBy("code").agg(*[F.sum(name).alias(name) for name in marks])
    once = lambda column: F.when(F.col(column) > 1, 1)
    times = {"repeated_code": once("_core"), "duplicate_code": once("_lists"), "unknown_code": F.when(F.col("code").isNull() | (F.col("_core") == 0), F.col("_lists")), "empty_list": F.col("_empty"), "repeated_tag": F.col("_doubled")}
    counted = per.select("code", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), n.cast("bigint").alias("n")) for kind, n in times.items()])).alias("x")).select("code", "x.*").where("n > 0")
    piece = counted.select("code", "kind", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(PIECE).cast("bigint"))).alias("at"))  # a row each, in pieces
    rows = piece.select("code", F.explode(F.array_repeat("kind", F.least(F.col("n") - F.col("at"), F.lit(PIECE)).cast("int"))).alias("kind"))
    seen = assignments.select(F.explode("tag_ids").alias("tag_id")).groupBy("tag_id").agg(F.count("*").alias("_n"))
    parts = [
        rows.select("kind", F.col("code").cast("string").alias("key")),
        found(unknown_tags(seen, definitions), "unknown_tag", "tag_id"),
        found(repeated(definitions, "id"), "repeated_definition", "id"),
        found(definitions.where(~F.coalesce(F.col("id") > 0, F.lit(False))), "invalid_definition", "id"),
    ]
    if "n" in definitions.columns:
        stated = definitions.join(seen.withColumnRenamed("tag_id", "id"), "id", "left")
        parts.append(found(stated.where(~F.col("n").eqNullSafe(F.coalesce("_n", F.lit(0)))), "count", "id"))
    return reduce(DataFrame.unionByName, parts)


def tag_lookup(records: DataFrame, definitions: DataFrame) -> DataFrame:
    """Definitions of each record's tags in the record's order; unknown ids drop out."""
    ids = records.select("code", F.posexplode("tag_ids").alias("_at", "id"))
    rows = ids.join(definitions, "id").select("code", "_at", F.struct("id", "group", "name").alias("tag"))
    found = rows.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "tag"))), lambda x: x["tag"]).alias("tags"))
    return found


def tags_by_group(records: DataFrame, definitions: DataFrame) -> DataFrame:
    """(code, group, tags): the tags of each record by group, in the record's order."""
    ids = records.select("code", F.posexplode("tag_ids").alias("_at", "id"))
    rows = ids.join(definitions.select("id", "group", "name"), "id")
    return rows.groupBy("code", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "id", "name"))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("tags"))


def tag_order(name: Column, collation: str | None = None) -> list[Column]:
    """Count first, then name (binary order, or a collation such as ``zh``), then id."""
    return [F.desc("n"), F.collate(name, collation) if collation else name, F.col("id")]


def stated_counts_differ(counts: DataFrame, stated: DataFrame) -> DataFrame:
    """Tags whose stated count is not the observed one; a count that is null or not stated at all never is."""
    return counts.select("id", "n").join(stated.select("id", F.col("n").alias("stated")), "id", "left").where(~F.col("n").eqNullSafe(F.col("stated")))


def sync_summary(records: DataFrame, targets: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row: records, complete, targets, tags."""
    return records.agg(F.count("*").alias("records"), F.count_if(F.col("tags_status") == "complete").alias("complete")).crossJoin(targets.agg(F.count("*").alias("targets"))).crossJoin(definitions.agg(F.count("*").alias("tags")))
