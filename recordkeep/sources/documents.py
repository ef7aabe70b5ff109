"""The catalogue as a document that is written and read in parts, and comes back as it was.

An export is a folder of JSON lines: the header, then each group followed by its records, the latest group first, then
the tags. Every line stands for itself and carries its place, so parts are range-partitioned by place, a group of any
size is spread over as many parts as it fills, and reading splits at any line, or at any part of a compressed export.
Keys are sorted and nulls left out, so equal snapshots give equal lines.

:func:`fragments` turns the same lines into pieces that, set one behind another, are the one nested document that other
readers expect; :func:`nested_tables` reads such a document.

Defined cases: absent and null fields are the same; a group without records is a line of its own; records of an unknown
group make one; an empty catalogue is its header; a part that is lost is found by :func:`gaps`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.operators.spread import placed
from recordkeep.plans.lineage import cut, discard, free_shuffles, scratch
from recordkeep.sources import snapshots

#: Columns of a record, by the names used in documents.
RECORD = {
    "code": "code", "number": "number", "title": "title", "actors": "actors", "release_date": "releaseDate", "cover": "cover", "product_id": "productId", "preview_base": "previewBase",
    "preview_count": "previewCount", "tag_ids": "tagIds", "tags_status": "tagsStatus", "tags_updated_at": "tagsUpdatedAt", "tags_source": "tagsSource",
}
TAG = {"id": "id", "group": "group", "name": "nameJa", "translation": "nameZh", "count": "count"}
_GROUP = "struct<code:string,count:bigint,firstReleaseDate:string,latestReleaseDate:string,links:map<string,string>>"
_TAG = "struct<count:bigint,group:string,id:bigint,nameJa:string,nameZh:string>"
_HEAD = "struct<generatedAt:string,lines:bigint,refresh:string,resources:map<string,string>,schemaVersion:int,totals:map<string,bigint>>"
#: Compression of what is cut on the way: lines are texts that hold much alike.
CODEC = "zstd"
LINE = f"group {_GROUP}, place bigint, record {snapshots.RECORD}, series string, snapshot {_HEAD}, tag {_TAG}"


@dataclass
class Tables:
    """A snapshot as tables. ``header`` is one row (schemaVersion, generatedAt, totals, refresh, resources)."""

    header: DataFrame
    records: DataFrame
    links: DataFrame
    group_links: DataFrame
    tags: DataFrame


def _inner(text: Column) -> Column:
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _quoted(c: Column) -> Column:
    """A text as JSON; one of plain letters and signs only needs its quotes."""
    return F.when(F.rlike(c, F.lit(r"^[ !#-\[\]-~]*\z")), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(_inner(F.to_json(F.array(c))))


def links_json(links: DataFrame) -> DataFrame:
    """(code, links): the leaves of a code as a two-level JSON object with sorted keys."""
    member = lambda k, v: F.concat(_quoted(k), F.lit(":"), v)
    leaf = F.struct("scope", F.col("provider").alias("k"), "url", member(F.col("provider"), _quoted(F.col("url"))).alias("v"))
    own = links.select("code", leaf.alias("x")).groupBy("code").agg(F.sort_array(F.collect_list("x")).alias("m"))  # as many as there are providers and scopes
    of = lambda scope: F.filter("m", lambda x: x["scope"].eqNullSafe(scope))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: x["v"]), ",")
    scopes = F.array_distinct(F.transform(F.filter("m", lambda x: ~x["scope"].eqNullSafe(F.lit(""))), lambda x: x["scope"]))
    nested = F.transform(scopes, lambda s: F.struct(s.alias("k"), member(s, F.concat(F.lit("{"), text(of(s)), F.lit("}"))).alias("v")))
    flat = F.transform(of(F.lit("")), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))
    return own.select("code", F.concat(F.lit("{"), text(F.sort_array(F.concat(flat, nested))), F.lit("}")).alias("links"))


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[fields[k].alias(k) for k in sorted(fields)])


def lines(t: Tables) -> DataFrame:
    """(place, snapshot, text) in document order from place 1; a line's text is its JSON but for the place, null for the header.

    Lines are made before they are sorted, so what is moved and written on the way is one text a line, and what is behind
    a step is deleted with the next.
    """
    day = F.coalesce("release_date", F.lit(""))
    groups = t.records.groupBy("prefix").agg(F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("latest"))
    linked = t.group_links.groupBy("prefix").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "url")))).alias("links"))
    groups = groups.join(linked, "prefix", "full_outer").select("prefix", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first", F.lit("")).alias("first"), F.coalesce("latest", F.lit("")).alias("latest"), "links")
    groups = cut(groups, "document-groups", free=True)
    key = lambda section, latest, prefix, kind, number, code: [c.alias(n) for c, n in zip((F.lit(section), latest, prefix, F.lit(kind), number, code), ("section", "latest", "series", "kind", "number", "code"), strict=True)]
    nothing, zero = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    group = _struct({"code": F.col("prefix"), "count": F.col("n"), "firstReleaseDate": F.col("first"), "latestReleaseDate": F.col("latest"), "links": F.col("links")})
    text = lambda cell: F.to_json(F.struct(cell)).alias("text")
    out = groups.select(*key(1, F.col("latest"), F.col("prefix"), 0, zero, nothing), text(group.alias("group")))
    own = t.records.join(groups.select("prefix", "latest"), "prefix").join(links_json(t.links), "code", "left")  # the links are the larger part, and are moved last
    cells = {RECORD[c]: F.col(c) for c in RECORD if c in t.records.columns}
    around = [_struct({c: v for c, v in cells.items() if (c < "links") == before}) for before in (True, False)]  # of a record's fields, the links are JSON already
    before, behind = (F.nullif(_inner(F.to_json(c)), F.lit("")) for c in around)
    record = F.concat(F.lit('{"record":{'), F.concat_ws(",", before, F.concat(F.lit('"links":'), F.col("links")), behind), F.lit('},"series":'), _quoted(F.col("prefix")), F.lit("}"))
    out = out.unionByName(own.select(*key(1, F.col("latest"), F.col("prefix"), 1, F.col("number"), F.col("code")), record.alias("text")))
    tag = _struct({TAG[c]: F.col(c) for c in TAG if c in t.tags.columns})
    out = out.unionByName(t.tags.select(*key(2, nothing, nothing, 0, F.col("id"), nothing), text(tag.alias("tag"))))
    head = _struct({c: F.col(c) for c in ("schemaVersion", "generatedAt", "totals", "refresh", "resources")})
    out = out.unionByName(t.header.select(*key(0, nothing, nothing, 0, zero, nothing), head.alias("snapshot")), allowMissingColumns=True)
    order = [F.asc("section"), F.desc("latest"), F.asc("series"), F.asc("kind"), F.asc("number"), F.asc("code")]
    made = cut(out, "document-lines", free=True, codec=CODEC)
    found = placed(made, order, free=True, codec=CODEC)
    discard(made)
    return found.select("place", "snapshot", "text")


def _record_json(record: Column, fields: list[str]) -> Column:
    """Like ``to_json``, with the links as the object that their text is."""
    cells = F.struct(*[(F.parse_json(record[f]) if f == "links" else record[f]).alias(f) for f in fields])
    return F.to_json(cells)


#: Lines of one part of an export.
PART = 200_000


def export(t: Tables, path: str, part: int = PART, compression: str | None = None) -> None:
    """Write the snapshot as JSON lines in document order, about ``part`` of them a file.

    What is cut on the way is deleted. Files of a ``compression`` such as gzip are read whole, so parts are the splits then.
    """
    spark = t.records.sparkSession
    with scratch(spark):
        _write(lines(t), path, part, compression)
    free_shuffles(spark)


def _write(found: DataFrame, path: str, part: int, compression: str | None) -> None:
    total = found.count()
    head = F.to_json(F.struct("place", F.col("snapshot").withField("lines", F.lit(total).cast("bigint")).alias("snapshot")))
    member = F.concat(F.lit('"place":'), F.col("place").cast("string"))
    first = F.startswith("text", F.lit('{"group":'))  # the one key before the place
    value = F.when(F.col("snapshot").isNotNull(), head).when(first, F.concat(F.regexp_replace("text", r"\}\z", ","), member, F.lit("}"))).otherwise(F.concat(F.lit("{"), member, F.lit(","), F.expr("substring(text, 2)")))
    own = found.select(F.floor((F.col("place") - 1) / part).cast("int").alias("part"), "place", value.alias("value"))
    own.repartitionById(-(-total // part), "part").sortWithinPartitions("place").select("value").write.text(path, compression=compression)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an export, in no order; only the fields asked for are parsed."""
    return spark.read.schema(LINE).json(path)


def _records(rows: DataFrame) -> DataFrame:
    """(prefix and RECORD columns, links as text) of (series, record)."""
    return rows.select(F.col("series").alias("prefix"), *[F.col(f"record.{own}").alias(c) for c, own in RECORD.items()], F.col("record.links").alias("links"))


def _tables(head: DataFrame, groups: DataFrame, rows: DataFrame, tags: DataFrame) -> Tables:
    full = _records(rows)
    shared = groups.select(F.col("group.code").alias("prefix"), F.explode("group.links").alias("provider", "url"))
    return Tables(head, full.drop("links"), snapshots.record_links(full), shared, tags.select(*[F.col(f"tag.{own}").alias(c) for c, own in TAG.items()]))


def read(spark: SparkSession, path: str, found: DataFrame | None = None) -> Tables:
    """The tables of an export, each a scan of the lines, or of ``found``: who needs several tables parses the lines once, and cuts."""
    every = read_lines(spark, path) if found is None else found
    head = every.where("snapshot is not null").select("snapshot.schemaVersion", "snapshot.generatedAt", "snapshot.totals", "snapshot.refresh", "snapshot.resources")
    return _tables(head, every.where("group is not null"), every.where("record is not null"), every.where("tag is not null"))


def nested_tables(document: DataFrame) -> Tables:
    """The tables of one nested document, as :func:`snapshots.read_document` reads it."""
    series = document.select(F.explode("series").alias("group"))
    rows = series.select(F.col("group.code").alias("series"), F.explode("group.videos").alias("record"))
    head = document.select("schemaVersion", "generatedAt", "totals", "refresh", "resources")
    return _tables(head, series, rows, document.select(F.explode("tags").alias("tag")))


def gaps(found: DataFrame) -> DataFrame:
    """One row (stated, lines, places) of the lines of an export; complete if all three are equal."""
    return found.agg(F.max("snapshot.lines").alias("stated"), F.count("*").alias("lines"), F.count_distinct("place").alias("places"))


def fragments(found: DataFrame) -> DataFrame:
    """Lines of an export -> (place, value): pieces of the nested document, whose keys are sorted as well.

    Whether a record or tag is the first of its list is seen from the line before it, by a join on the place.
    """
    first = found.where("record is null").select((F.col("place") + 1).alias("place"), F.lit(True).alias("starts"))
    rows = found.join(first, "place", "left").withColumn("starts", F.coalesce("starts", F.lit(False)))
    comma = F.when(F.col("starts"), "").otherwise(",")
    fields = sorted([*RECORD.values(), "links"])
    rest = lambda c: F.regexp_replace(F.to_json(c), r"\}$", "")
    opened = F.concat(rest(F.struct(*[F.col(f"group.{f}") for f in ("code", "count", "firstReleaseDate", "latestReleaseDate", "links")])), F.lit(',"videos":['))
    head = F.struct(*[F.col(f"snapshot.{f}") for f in ("generatedAt", "refresh", "resources", "schemaVersion")])
    before_group = F.when(F.col("place") == 2, "").otherwise("]},")
    last = found.agg(F.max("place").alias("end"), F.max(F.when(F.col("group").isNotNull(), F.col("place"))).alias("any"), F.min(F.when(F.col("tag").isNotNull(), F.col("place"))).alias("tag_from"))
    ends = F.broadcast(last)  # one row
    rows = rows.crossJoin(ends)
    close = F.when(F.col("any").isNotNull(), "]}").otherwise("")
    tag = F.concat(F.when(F.col("place") == F.col("tag_from"), F.concat(close, F.lit('],"tags":['))).otherwise(","), F.to_json(F.struct(*[F.col(f"tag.{f}") for f in sorted(TAG.values())])))
    value = (
        F.when(F.col("snapshot").isNotNull(), F.concat(rest(head), F.lit(',"series":[')))
        .when(F.col("group").isNotNull(), F.concat(before_group, opened))
        .when(F.col("record").isNotNull(), F.concat(comma, _record_json(F.col("record"), fields)))
        .otherwise(tag)
    )
    body = rows.select("place", value.alias("value"))
    totals = found.where("snapshot is not null").select(F.to_json("snapshot.totals").alias("totals"))
    tail = totals.crossJoin(ends).select((F.col("end") + 1).alias("place"), F.concat(F.when(F.col("tag_from").isNull(), close).otherwise(""), F.lit("]"), F.coalesce(F.concat(F.lit(',"totals":'), "totals"), F.lit("")), F.lit("}")).alias("value"))
    return body.unionByName(tail)
