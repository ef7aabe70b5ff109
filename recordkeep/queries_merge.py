"""Registered queries for sources, merges, tags, browsing, publishing and streams that the plain query module leaves out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recordkeep.functions import text
from recordkeep.operators import browse, gates, links, records, refresh, scans, tags
from recordkeep.plans.lineage import cut, session_dir
from recordkeep.queries import _BRIDGE, _LINKS, DAY, _t, bridge, incoming, one_leaf, orders, parts, previous, query
from recordkeep.queries_gates import _PAGED, _facts
from recordkeep.queries_values import BASE, base, cells_sql, made
from recordkeep.sources import pages as page_source
from recordkeep.sources import sheets, sinks, snapshots
from recordkeep.streaming import overlay as streaming

# --- landed pages ----------------------------------------------------------------------------------------------------

_DETAIL = """'<html><section id="works_pic"><h5> Title  ' || k || ' </h5><img src="/db/review/pac_s.jpg">' || CASE WHEN k % 5 = 1 THEN '' ELSE '<img src="/db/ord/pac_s.jpg">' END || '</section>'
|| CASE WHEN k % 6 = 1 THEN '' ELSE '<section id="works_txt"><dl><dt>作品番号 :</dt><dd> ord_00' || k || ' </dd><dt>出演女優</dt><dd><a>' || o_orderpriority || '</a> <a>one</a><a>one</a></dd><dt>DVDリリース日</dt><dd>' || replace(day, '-', '/') || '</dd></dl></section>' END
|| '<div id="tag"><div id="tag_header">ジャンルタグ</div><a href="../search/index.php?tag_id=' || (k + 1) || '">x  y</a><a href="../search/index.php?tag_id=' || (k + 1) || '">again</a><a href="../search/index.php?actor_id=1">no</a></div><div id="tag"><div id="tag_header">other</div><a href="../search/index.php?tag_id=7">z</a></div></html>'"""


def _details(spark, sf):
    rows = page_source.dealt(base(spark, sf).select("k", "o_orderpriority", "day"), "k")
    return rows.selectExpr("k AS page_id", f"{_DETAIL} AS html")


@query(f"""WITH {BASE} SELECT k AS page_id, CASE WHEN k % 6 <> 1 THEN 'ORD-' || k END AS code, CASE WHEN k % 6 <> 1 THEN 'Title ' || k END AS title, CASE WHEN k % 6 <> 1 THEN o_orderpriority || ',one' END AS actors,
CASE WHEN k % 6 <> 1 THEN day END AS release_date, CASE WHEN k % 6 <> 1 THEN 'https://www.example.com/db/' || CASE WHEN k % 5 = 1 THEN 'review' ELSE 'ord' END || '/pac_s.jpg' END AS cover FROM base""")
def page_details(spark, sf):
    found = page_source.detail_records(_details(spark, sf))
    return found.withColumn("actors", F.array_join("actors", ","))


@query(f"WITH {BASE} SELECT k AS page_id, k + 1 AS id, 'genre' AS \"group\", 'x y' AS name FROM base")
def page_tag_sections(spark, sf):
    return page_source.page_tags(_details(spark, sf))


_CARD = """'<div class="thumBox"><img src="/db/review/pac_s.jpg"><a href="/product/index.php?product_id=' || (k - k % 3 + 1) || '"><img src="/db/ord/pac_s.jpg"></a><p>code: ord_0' || k || '</p><h5>First ' || k || '</h5>
<!-- 出演: <span class="yaku"><a href="/x">one</a></span><span class="yaku"><a>two</a></span><br>other --><dl><dt>DVDリリース日</dt><dd>' || replace(day, '-', '/') || '</dd></dl></div>'
|| CASE WHEN k % 3 = 1 THEN '<div class="thumBox x"><a href="/product/index.php?product_id=' || (k + 5000000) || '">no cover</a></div>' WHEN k % 3 = 2 THEN '<div class="thumBox">nothing</div><a href="/product/index.php?product_id=99">side</a>' ELSE '' END"""


def _listings(spark, sf):
    """Listing pages of the orders of a customer; pages of three share an id."""
    rows = base(spark, sf).selectExpr("k", "k div 3 AS page_id", f"{_CARD} AS card")
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda x: x["card"]), "").alias("html"))


@query(f"""WITH {BASE} SELECT k // 3 AS page_id, k - k % 3 + 1 AS product_id, true AS parsed, count(*) AS n FROM base GROUP BY ALL UNION ALL SELECT k // 3, k + 5000000, false, 1 FROM base WHERE k % 3 = 1
UNION ALL SELECT k // 3, NULL, false, 1 FROM base WHERE k % 3 = 2""")
def listing_cards(spark, sf):
    return page_source.listing_cards(_listings(spark, sf)).groupBy("page_id", "product_id", "parsed").agg(F.count("*").alias("n"))


@query(f"WITH {BASE} SELECT k // 3 AS page_id, k + 1 AS product_id, 'ORD-' || k AS code, 'First ' || k AS title, 'one,two' AS actors, day AS release_date, 'https://www.example.com/db/ord/pac_s.jpg' AS cover FROM base WHERE k % 3 = 0")
def listing_first_of_id(spark, sf):
    found = page_source.listing_records(page_source.listing_cards(_listings(spark, sf)))
    return found.select("page_id", "product_id", "code", "title", F.array_join("actors", ",").alias("actors"), "release_date", "cover")


@query("SELECT page_id, sha256(CASE WHEN page_id % 4 = 1 AND regexp_matches(html, '[^\\x00-\\x7F]') THEN 'none' ELSE html END) AS hash FROM pages")
def decoded_pages(spark, sf):
    """Bodies in UTF-8, in UTF-16 as the header says, and in UTF-8 that a header calls ASCII, which then must not be guessed."""
    own = _t(spark, sf, "pages").withColumn("kind", F.col("page_id") % 4)
    wide, plain = F.encode("html", "UTF-16"), F.encode("html", "UTF-8")
    header = F.when(F.col("kind") == 1, "text/html; charset=us-ascii").when(F.col("kind") == 2, "text/html; charset=utf-16")
    bodies = own.select("page_id", F.when(F.col("kind") == 2, wide).otherwise(plain).alias("body"), header.alias("content_type"))
    return page_source.decoded(bodies).select("page_id", F.sha2(F.coalesce("html", F.lit("none")), 256).alias("hash"))


# --- sheets, documents, state ----------------------------------------------------------------------------------------

_SHEET = {
    "row_no": "CAST(k + 1 AS INT)",
    "a": "CASE k % 5 WHEN 1 THEN 'notes' ELSE ' ord_' || k END",
    "b": "CASE k % 3 WHEN 1 THEN ' ' ELSE ' http://s/' || k || ' ' END",
    "c": "CASE k % 4 WHEN 1 THEN 'bad url' END",
    "d": "'http://us/' || k",
}


@query(f"""WITH {BASE}, s AS ({cells_sql({**_SHEET, "row_no": "CAST(k + 1 AS INTEGER)"})}), l AS (SELECT row_no, a, '' AS scope, 'streamtape' AS provider, trim(b) AS url FROM s UNION ALL SELECT row_no, a, '', 'gofile', c FROM s UNION ALL SELECT row_no, a, 'uncensored', 'streamtape', d FROM s)
SELECT row_no, 'ORD-' || (row_no - 1) AS code, scope, provider, url FROM l WHERE a <> 'notes' AND url <> ''""")
def sheet_links(spark, sf):
    body = made(base(spark, sf), _SHEET).select("row_no", F.array("a", "b", "c", F.lit(None).cast("string"), F.lit(None).cast("string"), "d").alias("cells"))
    head = spark.createDataFrame([(0, ["﻿new code", "StreamTape", " gofile", "Player4Me", "uncensored", "streamtape", "GOFILE", "PLAYER4ME"])], "row_no int, cells array<string>")
    return sheets.link_cells(head.unionByName(body))


_CHILD = {
    "row_no": "CAST(k + 1 AS INT)",
    "a": "CASE k % 40 WHEN 1 THEN 'bad' WHEN 2 THEN 'zz-' || k WHEN 3 THEN 'ord-' || (k - 1 + 1000000000) ELSE 'ord_0' || k END",
    "b": "CASE k % 37 WHEN 1 THEN 'http://x/y' ELSE 'https://drive.google.com/file/d/x' || k END",
    "c": "CASE k % 41 WHEN 1 THEN 'more' END",
}


@query(f"""WITH {BASE}, s AS ({cells_sql({**_CHILD, "row_no": "k + 1", "k": "k"})}), r AS (SELECT *, CASE k % 40 WHEN 1 THEN NULL WHEN 2 THEN 'ZZ-' || k WHEN 3 THEN 'ORD-' || (k + 999999999) ELSE 'ORD-' || k END AS code FROM s UNION ALL SELECT *, 'ORD-' || k FROM s WHERE k = 4),
v AS (SELECT code, CASE WHEN c IS NOT NULL THEN 'width' WHEN code IS NULL THEN 'code' WHEN code LIKE 'ZZ%' THEN 'prefix' WHEN b LIKE 'http://x%' THEN 'url' END AS kind FROM r)
SELECT coalesce(code, '-') AS code, kind, count(*) AS n FROM (SELECT * FROM v WHERE kind IS NOT NULL UNION ALL SELECT code, 'unknown' FROM r WHERE code IS NOT NULL AND k % 40 IN (2, 3) UNION ALL SELECT code, 'repeated' FROM r WHERE code IS NOT NULL GROUP BY code HAVING count(*) > 1) GROUP BY ALL""")
def child_sheet_faults(spark, sf):
    rows = made(base(spark, sf), _CHILD).select("row_no", F.array("a", "b", "c").alias("cells"))
    head = spark.createDataFrame([(0, ["CODE", "url", None])], "row_no int, cells array<string>")
    again = rows.where("row_no = 5").withColumn("row_no", F.lit(2_000_000_000))
    _, bad = sheets.child_links(head.unionByName(rows).unionByName(again), "ORD", orders(spark, sf))
    return bad.groupBy(F.coalesce("code", F.lit("-")).alias("code"), "kind").agg(F.count("*").alias("n"))


_RICH = {
    "text": "CASE k % 7 WHEN 1 THEN 'not a name' ELSE ' c' || k || ' ' END",
    "color": "CASE k % 3 WHEN 0 THEN '#F00' WHEN 1 THEN 'rgb(255,0,0)' ELSE '#00ff00' END",
    "href": "CASE k % 4 WHEN 0 THEN 'https://drive.google.com/file/d/x' || k WHEN 1 THEN 'https://docs.google.com/spreadsheets/d/s' || k || '/edit' WHEN 2 THEN 'http://x/' || k END",
    "anchor": "CASE k % 2 WHEN 0 THEN 'a' || k END",
}


@query(f"WITH {BASE} SELECT 'C' || k AS prefix, CASE k % 4 WHEN 0 THEN 'drive' WHEN 1 THEN 'sheet' ELSE 'opaque' END AS kind, CASE k % 2 WHEN 0 THEN 'a' || k ELSE ' c' || k || ' ' END AS label FROM base WHERE k % 7 <> 1 AND k % 3 <> 2 AND k % 4 <> 3")
def directory_cells(spark, sf):
    return sheets.directory_links(made(base(spark, sf), _RICH), "#ff0000").select("prefix", "kind", "label")


def _document(spark, sf):
    """Snapshot documents of the orders, a document of one group each, as JSON and back."""
    link = F.expr("CASE WHEN number % 3 = 0 THEN concat('{\"gofile\":\"http://g/', number, '\",\"uncensored\":{\"gofile\":\"http://u/', number, '\"}}') END")
    own = orders(spark, sf).withColumn("series", F.concat(F.lit("c"), F.col("prefix").cast("string")))
    video = F.struct(F.when(F.col("number") % 50 != 1, F.col("code")).alias("code"), "number", "title", F.col("release_date").alias("releaseDate"), link.alias("links"))
    shared = F.when(F.col("series").endswith("1"), F.create_map(F.lit("subtitle"), F.concat(F.lit("http://d/"), "series")))
    groups = own.groupBy("series").agg(F.collect_list(video).alias("videos"))
    whole = groups.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.array(F.struct(F.col("series").alias("code"), "videos", shared.alias("links"))).alias("series"), F.create_map(F.lit("label"), "series").alias("resources"))).alias("value"))
    return whole.select(F.from_json("value", snapshots.DOCUMENT).alias("d")).select("d.*")


@query(f"WITH {BASE} SELECT 'C' || o_custkey AS series, 'ORD-' || k AS code, k AS number, o_orderpriority AS title, day AS release_date FROM base WHERE k % 50 <> 1")
def loaded_documents(spark, sf):
    return snapshots.load_model(snapshots.flatten(_document(spark, sf))).select("series", "code", "number", "title", F.col("releaseDate").alias("release_date"))


@query(f"""WITH {BASE} SELECT 'record' AS level, 'ORD-' || k AS key, '' AS scope, 'gofile' AS provider, 'http://g/' || k AS url FROM base WHERE k % 3 = 0 AND k % 50 <> 1
UNION ALL SELECT 'record', 'ORD-' || k, 'uncensored', 'gofile', 'http://u/' || k FROM base WHERE k % 3 = 0 AND k % 50 <> 1 UNION ALL SELECT DISTINCT 'group', 'c' || o_custkey, '', 'subtitle', 'http://d/c' || o_custkey FROM base WHERE ('' || o_custkey) LIKE '%1'""")
def document_links(spark, sf):
    document = _document(spark, sf)
    own = snapshots.record_links(snapshots.flatten(document).where("code is not null")).select(F.lit("record").alias("level"), F.col("code").alias("key"), "scope", "provider", "url")
    return own.unionByName(snapshots.group_links(document).select(F.lit("group").alias("level"), F.col("prefix").alias("key"), F.lit("").alias("scope"), "provider", "url"))


@query("SELECT 'c' || max(o_custkey) AS label FROM orders")
def replaced_resource(spark, sf):
    rows = _document(spark, sf).select(F.col("resources")["label"].alias("label"))
    number = F.regexp_extract("label", "([0-9]+)", 1).cast("bigint")
    old, new = rows.agg(F.min("label").alias("label")), rows.agg(F.max_by("label", number).alias("label"))
    return snapshots.resources(old, new)


@query(f"""WITH {BASE} SELECT 'ORD-' || k AS code, o_orderpriority AS title, day AS release_date, CASE WHEN k % 3 = 0 THEN 'http://s/' || k END AS url FROM base WHERE k % 4 <> 1""")
def legacy_export(spark, sf):
    own = base(spark, sf)
    r = F.create_map(F.lit("code"), F.expr("CASE WHEN k % 4 = 1 THEN 'bad' ELSE 'ord_0' || k END"), F.lit("title"), "o_orderpriority", F.when(F.col("k") % 2 == 0, "date").otherwise("releaseDate"), F.col("day"))
    listed = own.groupBy("o_custkey").agg(F.collect_list(r).alias("l"))
    even = F.col("o_custkey") % 2 == 0
    documents = listed.select(F.when(even, F.to_json("l")).otherwise(F.concat(F.lit('{"g":'), F.to_json("l"), F.lit("}"))).alias("value"))
    linked = own.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(F.expr("'ord_' || k AS code"), F.create_map(F.lit("st"), F.expr("CASE WHEN k % 3 = 0 THEN ' http://s/' || k ELSE '' END")).alias("m")))).alias("m"))
    found = snapshots.legacy_links(linked.select(F.to_json("m").alias("value"))).where("provider = 'streamtape'").select("code", "url")
    return snapshots.legacy_records(documents).select("code", "title", "release_date").join(found, "code", "left")


@query(f"WITH {BASE} SELECT 'ORD-' || k AS key, '' || (k + 1) AS value, k % 3 = 0 AS audited FROM base")
def prior_state_maps(spark, sf):
    own = base(spark, sf)
    maps = own.select(F.to_json(F.create_map(F.expr("'ORD-' || k"), F.col("k") + 1)).alias("value"))
    when = F.when(F.col("k") % 3 == 0, F.concat("day", F.lit("T00:00:00Z"))).otherwise("nonsense")
    state = own.select(F.to_json(F.struct(F.create_map(F.lit("k"), F.expr("'ORD-' || k")).alias("inputs"), F.struct(when.alias("lastAuditAt")).alias("official"))).alias("value"))
    known = snapshots.prior_state(state).select(F.col("inputs")["k"].alias("key"), F.col("last_audit").isNotNull().alias("audited"))
    return snapshots.override_map(maps).join(known, "key")


@query("SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT p_partkey + 1000000000, 'x' || p_name FROM part")
def stored_tag_choice(spark, sf):
    """A valid file is taken, one with a blank name is not."""
    own = parts(spark, sf)
    other = own.select((F.col("id") + 1_000_000_000).alias("id"), "group", F.concat(F.lit("x"), "name").alias("name"))
    refused = other.withColumn("name", F.when(F.col("id") % 50 == 1, " ").otherwise(F.col("name")))
    valid = other.where("id > 0")
    return snapshots.stored_tags(refused, own).select("id", "name").unionByName(snapshots.stored_tags(valid, own).select("id", "name"))


# --- merges ------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 1 THEN 'ORD-' || o_orderkey END AS code FROM orders) SELECT k AS product_id, CASE WHEN k % 3 = 1 AND k % 2 = 0 THEN 'ORD-' || k ELSE code END AS code, k % 3 <> 1 OR k % 2 = 0 AS resolved FROM c""")
def resolved_cards(spark, sf):
    cards = orders(spark, sf).select(F.col("number").alias("product_id"), F.when(F.col("number") % 3 != 1, F.col("code")).alias("code"))
    details = orders(spark, sf).where("number % 2 = 0").select(F.col("number").alias("product_id"), "code")
    return refresh.resolve_unparsed(cards, details)


@query(f"""WITH {BASE}, x AS (SELECT k, 'ORD-' || k AS code, o_orderpriority AS title FROM base) SELECT code, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'new' ELSE title END AS title, CASE WHEN k % 3 = 0 THEN CASE WHEN k > 0 THEN k || ',' ELSE '' END || (k + 5) ELSE '' END AS tag_ids,
CASE WHEN k % 3 = 0 THEN 'complete' END AS tags_status FROM x""")
def enriched_records(spark, sf):
    rec = orders(spark, sf).select("code", "title", *[F.lit(None).cast("array<bigint>" if c == "tag_ids" else "string").alias(c) for c in tags.TAG_FIELDS])
    k = F.col("number")
    details = orders(spark, sf).where("number % 3 = 0").select("code", F.when(k % 2 == 0, "new").alias("title"), F.array(k + 5, k, k, F.lit(-1)).cast("array<bigint>").alias("tag_ids"))
    found = tags.apply_details(rec, details, "2024-01-01T00:00:00Z")
    ids = F.array_join(F.transform(F.coalesce("tag_ids", F.array().cast("array<bigint>")), lambda x: x.cast("string")), ",")
    return found.select("code", "title", ids.alias("tag_ids"), "tags_status")


@query("SELECT 'ORD-' || o_orderkey AS code, 'ORD-' || o_orderkey || '00' AS found FROM orders WHERE o_orderkey % 10 = 3")
def detail_mismatches(spark, sf):
    rec = orders(spark, sf).select("code", F.col("number").alias("product_id"))
    details = rec.select("product_id", F.when(F.col("product_id") % 10 == 3, F.concat("code", F.lit("00"))).otherwise(F.col("code")).alias("code"))
    return tags.detail_mismatches(rec, details)


@query(f"WITH {BASE} SELECT 'ORD-' || k AS code, CASE WHEN k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN day || 'T00:00:00Z' ELSE 'now' END WHEN k % 2 = 0 THEN day || 'T00:00:00Z' ELSE 'x' END AS tags_updated_at, CASE WHEN k % 3 = 1 THEN 'official-unavailable' END AS tags_source FROM base")
def unavailable_records(spark, sf):
    rows = made(base(spark, sf), {"code": "'ORD-' || k", "product_id": "CASE WHEN k % 3 <> 1 THEN k END", "tags_updated_at": "CASE WHEN k % 2 = 0 THEN day || 'T00:00:00Z' ELSE 'x' END"})
    rows = rows.withColumns({"tag_ids": F.array().cast("array<bigint>"), "tags_status": F.lit(None).cast("string"), "tags_source": F.lit(None).cast("string")})
    return tags.mark_unavailable(rows, "now").select("code", "tags_updated_at", "tags_source")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'live ' || p_name ELSE p_name END AS name FROM part UNION ALL SELECT p_partkey + 1000000000, p_name FROM part WHERE p_partkey % 4 = 0")
def merged_definitions(spark, sf):
    own = parts(spark, sf)
    live = own.where("id % 2 = 0").withColumn("name", F.concat(F.lit("live "), "name")).unionByName(own.where("id % 4 = 0").withColumn("id", F.col("id") + 1_000_000_000))
    return tags.merge_definitions(live, own).select("id", "name")


@query("""SELECT p_partkey + 1 AS id, p_name AS name, CASE WHEN p_size < 10 THEN 'R' || p_name WHEN p_partkey % 3 = 0 THEN 'T' || p_partkey ELSE p_name END AS translation,
CASE WHEN p_size < 10 THEN 'reviewed' WHEN p_partkey % 5 = 0 THEN 'said' WHEN p_partkey % 3 = 0 THEN 'machine' ELSE 'official' END AS source FROM part WHERE p_partkey % 7 <> 1""")
def normalized_definitions(spark, sf):
    """Two versions of each definition, the second of which wins; an unknown group, a blank name and a bad id drop out."""
    p = _t(spark, sf, "part").selectExpr("p_partkey AS k", "p_partkey + 1 AS id", "p_name", "p_size")
    last = p.selectExpr("2 AS seq", "id", "CASE WHEN k % 7 = 1 THEN 'other' ELSE 'genre' END AS `group`", "'  ' || replace(p_name, ' ', '   ') AS name", "CASE WHEN k % 3 = 0 THEN 'T' || k ELSE ' ' END AS translation", "CASE WHEN k % 5 = 0 THEN 'said' END AS source")
    first = last.withColumns({"seq": F.lit(1), "translation": F.lit("old")})
    odd = last.withColumns({"id": -F.col("id")}).unionByName(last.withColumn("name", F.lit(" ")))
    # names repeat in the table, and so do reviews by name: a name counts as reviewed by the part's own size
    reviewed = p.where("p_size < 10").selectExpr("p_name || ' #' || id AS name", "'R' || p_name AS translation")
    mark = lambda df: df.withColumn("name", F.when(F.trim("name") != "", F.concat("name", F.lit(" #"), F.abs("id").cast("string"))).otherwise(F.col("name")))
    plain = F.regexp_replace("name", " #[0-9]+$", "")
    found = tags.normalize_definitions(mark(first.unionByName(last).unionByName(odd)), reviewed=reviewed)
    return found.select("id", plain.alias("name"), F.regexp_replace("translation", " #[0-9]+$", "").alias("translation"), "source")


@query("""SELECT p_partkey + 1 AS id, CASE WHEN p_partkey % 5 IN (1, 2, 3) THEN 'second' ELSE p_name END AS name, 'T' || p_name AS translation, CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE 7 END AS "count" FROM part WHERE p_partkey % 7 <> 1""")
def first_definitions(spark, sf):
    """The first definition of some ids has an unknown group, a blank name or no translation, so that the next one holds; some have no valid one."""
    p = _t(spark, sf, "part")
    first = p.selectExpr("1 AS seq", "p_partkey AS k", "p_partkey + 1 AS id", "CASE WHEN p_partkey % 5 = 1 THEN 'other' ELSE 'genre' END AS `group`", "CASE WHEN p_partkey % 5 = 2 THEN ' ' ELSE '  ' || p_name END AS name", "CASE WHEN p_partkey % 5 <> 3 THEN 'T' || p_name END AS translation", "CASE WHEN p_partkey % 5 = 4 THEN -1 ELSE 7 END AS count")
    second = p.selectExpr("2 AS seq", "p_partkey AS k", "p_partkey + 1 AS id", "'character' AS `group`", "'second' AS name", "'T' || p_name AS translation", "CASE WHEN p_partkey % 5 = 4 THEN -1 ELSE 7 END AS count")
    odd = second.withColumns({"seq": F.lit(0), "id": -F.col("id")})
    bad = first.unionByName(second).unionByName(odd).withColumn("group", F.when(F.col("k") % 7 == 1, "none").otherwise(F.col("group")))
    return tags.first_definitions(bad).select("id", "name", "translation", F.col("count"))


@query(f"""WITH {_BRIDGE}, j AS (SELECT code, s_suppkey, s_nationkey % 2 AS g, s_name FROM bridge JOIN supplier ON s_suppkey = tag_id WHERE s_suppkey % 5 <> 2)
SELECT code, CASE g WHEN 0 THEN 'even' ELSE 'odd' END AS "group", string_agg(s_name, ',' ORDER BY s_suppkey DESC) AS tags FROM j GROUP BY ALL""")
def tags_by_group(spark, sf):
    ids = bridge(spark, sf).groupBy("code").agg(F.sort_array(F.collect_set("tag_id"), False).alias("tag_ids"))
    named = _t(spark, sf, "supplier").where("s_suppkey % 5 <> 2").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("group"), F.col("s_name").alias("name"))
    return tags.tags_by_group(ids, named).select("code", "group", F.array_join(F.transform("tags", lambda t: t["name"]), ",").alias("tags"))


@query("SELECT 'C' || o_custkey AS prefix, 'gofile' AS provider, min('http://g/' || o_orderkey) AS url, count(DISTINCT 'http://g/' || o_orderkey) AS seen FROM orders WHERE o_orderkey % 5 <> 1 GROUP BY o_custkey")
def min_wins_group_links(spark, sf):
    rows = base(spark, sf).selectExpr("CASE k % 4 WHEN 0 THEN ' c' || o_custkey ELSE 'C' || o_custkey END AS prefix", "'gofile' AS provider", "CASE WHEN k % 5 = 1 THEN ' ' ELSE ' http://g/' || k END AS url")
    rows = rows.unionByName(rows.withColumn("prefix", F.lit("9 no name")))
    return links.smallest_group_wins(rows).select("prefix", "provider", "url", F.size("seen").cast("bigint").alias("seen"))


@query("SELECT o_custkey AS prefix, count(*) AS n, CASE WHEN o_custkey % 3 = 1 THEN 'gofile=http://g/' || o_custkey || ' subtitle=http://s/' || o_custkey END AS links FROM orders GROUP BY o_custkey")
def groups_with_links(spark, sf):
    groups = records.build_groups(orders(spark, sf))
    own = groups.where("prefix % 3 = 1").select("prefix", F.explode(F.array(F.lit("subtitle"), F.lit("gofile"))).alias("provider"))
    own = own.withColumn("url", F.concat(F.lit("http://"), F.substring("provider", 1, 1), F.lit("/"), F.col("prefix").cast("string")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("links")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return links.attach_group_links(groups, own).select("prefix", "n", shown.alias("links"))


@query(f"""{_LINKS}, p AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'), i AS (SELECT *, CASE WHEN o_orderpriority = '2-HIGH' THEN 'HIGH' ELSE o_orderpriority END AS t FROM orders WHERE o_orderstatus <> 'F'),
a AS (SELECT code, string_agg(provider || url, ' ' ORDER BY provider) AS l FROM old GROUP BY code), b AS (SELECT code, string_agg(provider || url, ' ' ORDER BY provider) AS l FROM new GROUP BY code),
m AS (SELECT p.o_orderkey AS x, i.o_orderkey AS y, p.o_orderpriority <> i.t AS changed, 'ORD-' || coalesce(p.o_orderkey, i.o_orderkey) AS code FROM p FULL JOIN i USING (o_orderkey)),
z AS (SELECT m.*, CASE WHEN x IS NOT NULL THEN a.l END AS l0, CASE WHEN y IS NOT NULL THEN b.l END AS l1 FROM m LEFT JOIN a USING (code) LEFT JOIN b USING (code))
SELECT count(*) FILTER (x IS NULL) AS added, count(*) FILTER (changed) AS updated, count(*) FILTER (NOT changed) AS retained, count(*) FILTER (y IS NULL) AS deleted,
count(*) FILTER (l0 IS NULL AND l1 IS NOT NULL) AS link_added, count(*) FILTER (l0 <> l1) AS link_updated, count(*) FILTER (l0 IS NOT NULL AND l1 IS NULL) AS link_removed,
(SELECT count(DISTINCT code) FROM new JOIN i ON code = 'ORD-' || o_orderkey) AS linked, (SELECT count(*) + 3 FROM old JOIN new USING (code, scope, provider) WHERE old.url <> new.url) AS link_conflicts FROM z""")
def refresh_counters(spark, sf):
    """All nine counters of a refresh: records, their links, and conflicts met, three of which the sheet brought."""
    old, new = (cut(one_leaf(spark, sf, flag), "refresh-links") for flag in ("R", "A"))  # each is read for maps and for conflicts

    def side(df, leaf):
        return links.attach_links(df, leaf).withColumn("links", F.to_json("links"))

    changes = refresh.diff(side(previous(spark, sf), old), side(incoming(spark, sf), new), "links")
    shown = new.join(incoming(spark, sf).select("code"), "code", "left_semi")
    return refresh.refresh_counts(changes, shown, links.append_conflicts(old, new), supplied=3)


@query(f"WITH {BASE} SELECT 'ORD-' || k AS code, 'covers/' || k AS path FROM base WHERE k % 4 <> 1")
def accepted_covers(spark, sf):
    rows = orders(spark, sf)
    path = F.concat(F.lit("covers/"), F.col("number").cast("string"))
    manifest = rows.select("code", F.when(F.col("number") % 4 == 1, "covers/x").otherwise(path).alias("path")).unionByName(spark.createDataFrame([("ORD-none", "covers/none")], "code string, path string"))
    return browse.covers_accepted(manifest, rows, path).select("code", "path")


@query("""WITH s AS (SELECT DISTINCT 'ORD-' || o_orderkey AS code, o_orderkey FROM orders) SELECT code, 'seed' AS side FROM s WHERE o_orderkey % 2 = 0 UNION ALL SELECT code, 'found' FROM s WHERE o_orderkey % 3 = 0""")
def first_run_candidates(spark, sf):
    rows = orders(spark, sf)
    seed, found = rows.where("number % 2 = 0").select("code", F.lit("seed").alias("side")), rows.where("number % 3 = 0").select("code", F.lit("found").alias("side"))
    return refresh.candidates(seed, found, refresh.Refresh(), has_previous=False)


@query("""WITH r AS (SELECT 'ORD-' || o_orderkey AS code, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS title FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0),
f AS (SELECT code, '{"code":"' || code || '"' || coalesce(',"title":"' || title || '"', '') || '}' AS f FROM r) SELECT code, row_number() OVER (ORDER BY f) AS place FROM f""")
def canonical_order(spark, sf):
    rows = orders(spark, sf)
    both = refresh.directory_and_tail(rows.where("number % 2 = 0").select("code", "title"), rows.where("number % 2 = 1 and number % 3 = 0").select("code"))
    return browse.placed(both, [text.fingerprint(both)]).select("code", "place")


@query("SELECT DISTINCT 'ORD-' || o_orderkey AS code, 'ORD' AS prefix FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def known_keys(spark, sf):
    rows = base(spark, sf)
    return refresh.known_keys(rows.where("k % 2 = 0").selectExpr("'ORD-' || k AS code"), rows.where("k % 3 = 0").selectExpr("' ord_0' || k AS code"))


@query(f"WITH {BASE} SELECT k, CASE WHEN k % 3 = 1 THEN 'url' ELSE '' END AS missing, CASE WHEN k % 3 = 2 THEN 'more' ELSE '' END AS extra FROM base WHERE k % 3 > 0")
def map_key_errors(spark, sf):
    rows = base(spark, sf).select("k", F.expr("CASE k % 3 WHEN 1 THEN map('label', 'x') WHEN 2 THEN map('label', 'x', 'url', 'y', 'more', 'z') ELSE map('url', 'y', 'label', 'x') END").alias("m"))
    return refresh.key_errors(rows, "m", ("label", "url")).select("k", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query(f"WITH {BASE}, d AS (SELECT CASE k % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'child' ELSE 'unresolved' END AS state, 'group' AS scope, 'C' || k AS prefix FROM base WHERE k % 7 <> 1 AND k % 3 <> 2 AND k % 4 <> 3 UNION ALL SELECT 'resolved', 'record', 'ORD' FROM base WHERE k % 5 = 0) SELECT state, scope, prefix, count(*) AS n FROM d GROUP BY ALL")
def source_manifest(spark, sf):
    return _manifest(spark, sf).groupBy("state", "scope", "prefix").agg(F.count("*").alias("n"))


def _manifest(spark, sf):
    directory = sheets.directory_links(made(base(spark, sf), _RICH), "#ff0000")
    return sheets.manifest(directory, base(spark, sf).where("k % 5 = 0").selectExpr("'ORD-' || k AS code", "'https://drive.google.com/file/d/r' || k AS url"))


_WORDS = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT)::VARCHAR AS w{i}" for i in range(8))


@query(f"""WITH {BASE}, r AS ({cells_sql({**_RICH, "k": "k"})}), d AS (SELECT 'group' AS scope, CASE k % 4 WHEN 0 THEN 'resolved' WHEN 2 THEN 'unresolved' END AS state, href AS url FROM r WHERE k % 7 <> 1 AND k % 3 <> 2 AND k % 4 <> 3
UNION ALL SELECT 'record', 'resolved', 'https://drive.google.com/file/d/r' || k FROM base WHERE k % 5 = 0), s AS (SELECT *, sha256(url) AS h FROM d),
t AS (SELECT scope, count(*) AS n, count(*) FILTER (state = 'resolved') AS resolved, count(*) FILTER (state = 'unresolved') AS unresolved, {_WORDS} FROM s GROUP BY scope)
SELECT scope, n, resolved, unresolved, sha256(concat_ws(':', n::VARCHAR, w0, w1, w2, w3, w4, w5, w6, w7)) AS hash FROM t""")
def source_summary(spark, sf):
    return sinks.source_summary(_manifest(spark, sf))


# --- scans, counts, browsing -------------------------------------------------------------------------------------------


@query(f"""WITH {_PAGED}, j AS (SELECT a.page, cards, resolved, complete OR page < 5 AS complete, new FROM a JOIN n USING (page)), e AS (SELECT page, 'error' AS why FROM j WHERE NOT complete UNION ALL
SELECT y.page, 'all_known' FROM j x JOIN j y ON y.page = x.page + 1 WHERE x.new = 0 AND y.new = 0 AND x.complete AND y.complete), z AS (SELECT min(page) AS cutoff, arg_min(why, page) AS why FROM e)
SELECT count(*) AS pages, sum(cards)::BIGINT AS cards, sum(resolved)::BIGINT AS parsed, sum(new)::BIGINT AS new, (sum(resolved) - sum(new))::BIGINT AS known, count(*) FILTER (NOT complete) AS errors, coalesce(max(cutoff), max(page)) AS "cursor", coalesce(max(why), 'page_limit') AS stop_reason
FROM j, z WHERE cutoff IS NULL OR page <= cutoff""")
def scan_summary(spark, sf):
    facts = _facts(spark, sf).withColumn("complete", F.col("complete") | (F.col("page") < 5))
    return scans.scan_summary(facts)


@query("""WITH p AS (SELECT range AS page FROM range(0, (SELECT max(event_id) // 100 + 3 FROM events))), c AS (SELECT event_id // 100 AS page, count(*) AS cards FROM events GROUP BY 1)
SELECT min(p.page) AS cutoff, 'empty' AS stop_reason FROM p LEFT JOIN c USING (page) WHERE cards IS NULL""")
def audit_stop(spark, sf):
    """An audit goes on over known pages and ends on the first empty one."""
    cards = _t(spark, sf, "events").select(F.expr("event_id div 100 AS page"), F.col("user_id").alias("product_id"))
    last = cards.agg((F.max("page") + 2).alias("last"))
    fetched = last.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("page"))
    new = scans.page_novelty(cards, spark.createDataFrame([], "product_id long"), fetched=fetched)
    facts = new.join(cards.groupBy("page").agg(F.count("*").alias("cards")), "page", "left").select("page", "new", F.coalesce("cards", F.lit(0)).alias("cards"), F.lit(True).alias("complete"))
    return scans.scan_stop(facts, "audit")


@query(f"WITH {_PAGED} SELECT bool_and(complete) AS authoritative, false AS unfinished FROM a")
def authoritative_scan(spark, sf):
    facts = _facts(spark, sf)
    return scans.scan_authoritative(facts, True, True).crossJoin(scans.scan_authoritative(facts, True, False).withColumnRenamed("authoritative", "unfinished"))  # one row each


@query("SELECT count(*) AS records, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey > 0) AS targets, (SELECT count(*) FROM part) AS tags FROM orders")
def tag_sync_summary(spark, sf):
    rows = orders(spark, sf).select("code", F.col("number").alias("product_id"), F.when(F.col("status") == "F", "complete").alias("tags_status"), F.lit("2024-01-01T00:00:00Z").alias("tags_updated_at"))
    return tags.sync_summary(rows, tags.sync_targets(rows, "2024-01-02T00:00:00Z"), parts(spark, sf))


@query("SELECT 'ORD-' || o_orderkey AS code, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey > 0")
def sync_all(spark, sf):
    rows = orders(spark, sf).select("code", F.col("number").alias("product_id"), F.lit("complete").alias("tags_status"), F.lit("x").alias("tags_updated_at"))
    found = tags.sync_targets(rows, "2024-01-02T00:00:00Z", full=True)
    return browse.placed(found, [F.col("urgency"), F.col("product_id")]).select("code", "place")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 1 THEN n + 1 END AS stated, n FROM (SELECT p_partkey, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey = p_partkey) AS n FROM part) WHERE p_partkey % 10 IN (1, 3, 5)")
def stated_tag_counts(spark, sf):
    counted = tags.tag_counts(bridge(spark, sf, "l_partkey"), parts(spark, sf))
    k = F.col("id") % 10
    return tags.stated_counts_differ(counted, counted.where(k != 5).select("id", F.when(k == 1, F.col("n") + 1).when(k != 3, F.col("n")).alias("n")))


@query("""WITH b AS (SELECT DISTINCT 'ORD-' || l_orderkey AS code, l_suppkey AS t FROM lineitem), n AS (SELECT t, count(*) AS n FROM b GROUP BY t)
SELECT 'unknown_code' AS kind, code AS key FROM (SELECT DISTINCT code FROM b) WHERE code NOT IN (SELECT 'ORD-' || o_orderkey FROM orders WHERE o_orderkey % 50 <> 1)
UNION ALL SELECT 'empty_list', 'ORD-' || o_orderkey FROM orders WHERE o_orderkey % 90 = 2 AND 'ORD-' || o_orderkey NOT IN (SELECT code FROM b) UNION ALL SELECT 'unknown_tag', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 5 = 2
UNION ALL SELECT 'invalid_definition', '0' UNION ALL SELECT 'count', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 5 = 1""")
def hydration_errors(spark, sf):
    pairs = bridge(spark, sf)
    listed = cut(pairs.groupBy("code").agg(F.sort_array(F.collect_set("tag_id")).alias("tag_ids")), "hydration-lists")
    rows = orders(spark, sf)
    bare = rows.where("number % 90 = 2").select("code").join(listed, "code", "left_anti").select("code", F.array().cast("array<bigint>").alias("tag_ids"))
    defined = tags.tag_counts(pairs, _t(spark, sf, "supplier").where("s_suppkey % 5 <> 2").select(F.col("s_suppkey").alias("id")))
    stated = defined.select("id", F.when(F.col("id") % 5 == 1, F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return tags.hydrate_errors(rows.where("number % 50 <> 1").select("code"), listed.unionByName(bare), stated)


@query("SELECT 'generation' AS kind, (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS key")
def generation_errors(spark, sf):
    day = orders(spark, sf).agg(F.max("release_date").alias("generated_at"), F.min("release_date").alias("older"))
    return tags.generation_errors(day.select(F.col("older").alias("generated_at")), day.select(F.lit(1).alias("schema_version"), "generated_at"))


def _catalog(spark, sf):
    o = orders(spark, sf)
    ids = bridge(spark, sf, "l_partkey").groupBy("code").agg(F.sort_array(F.collect_set("tag_id")).alias("tag_ids"))
    rows = o.select("code", F.concat(F.lit("C"), F.col("prefix").cast("string")).alias("prefix"), "number", "title", F.array().cast("array<string>").alias("actors"), "release_date").join(ids, "code", "left")
    named = parts(spark, sf).withColumn("translation", F.upper("group"))
    log = o.select(F.col("release_date").alias("generated_at"), "number")
    return browse.Catalog(rows, records.build_groups(rows), named, one_leaf(spark, sf).withColumn("provider", F.when(F.col("provider") == "p1", "gofile").otherwise(F.col("provider"))), log)


@query("""WITH t AS (SELECT DISTINCT 'ORD-' || l_orderkey AS code FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_type || ' ' || p_name), 'standard small')), g AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1)
SELECT 'ORD-' || o_orderkey AS code, row_number() OVER (ORDER BY d DESC, 'C' || o_custkey, o_orderkey) AS place FROM orders JOIN g USING (o_custkey) JOIN t ON code = 'ORD-' || o_orderkey""")
def catalog_search(spark, sf):
    """Full-width letters, blanks and case fold away; the order is that of groups and numbers."""
    found = _catalog(spark, sf).search(" Ｓtandard   SMALL")
    latest = _catalog(spark, sf).groups.select("prefix", "latest_date")
    return browse.placed(found.join(latest, "prefix"), [F.desc("latest_date"), F.col("prefix"), F.col("number")]).select("code", "place")


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_type || ' ' || p_name), 'widget') AND p_type = 'ECONOMY'")
def tag_search(spark, sf):
    return _catalog(spark, sf).search_tags(" WIDGET ", "ECONOMY").select("id")


@query("SELECT 'record' AS kind, 'ORD-7' AS key UNION ALL SELECT 'group', 'C' || min(o_custkey) FROM orders UNION ALL SELECT 'tag', '3' UNION ALL SELECT 'tags', p_partkey::VARCHAR FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT 'latest', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders")
def point_lookups(spark, sf):
    c = _catalog(spark, sf)
    group = c.groups.agg(F.min(F.expr("cast(substring(prefix, 2) as bigint)"))).first()[0]
    found = [("record", c.get_record(" ord_007"), "code"), ("group", c.get_group(f" c{group}"), "prefix"), ("tag", c.get_tag(3), "id"), ("tags", c.get_tags("ECONOMY"), "id"), ("latest", c.metadata(), "generated_at")]
    return gates.union([df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key")) for kind, df, key in found])


@query("""WITH g AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), r AS (SELECT o_orderkey AS number, 'ORD-' || o_orderkey AS code FROM orders WHERE o_custkey = (SELECT o_custkey FROM g)) SELECT number, code FROM r ORDER BY number LIMIT 5 OFFSET 2""")
def group_page(spark, sf):
    c = _catalog(spark, sf)
    largest = c.groups.orderBy(F.desc("n"), F.expr("cast(substring(prefix, 2) as bigint)")).first().prefix
    return c.group_page(largest, 2, 5)[0].select("number", "code")


@query("SELECT 'ORD-' || event_id AS code FROM events JOIN orders ON o_orderkey = event_id WHERE event_type = 'purchase' ORDER BY 1 LIMIT 20 OFFSET 3")
def favourites_page(spark, sf):
    state = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    marks = _t(spark, sf, "events").select(F.concat(F.lit("ORD-"), F.col("event_id").cast("string")).alias("code"), state.alias("state"))
    return _catalog(spark, sf).favourites_page(marks, 2, 3, 20)[0].select("code")


@query("""WITH p AS (SELECT DISTINCT p_type, p_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 7), t AS (SELECT p_type || '=' || string_agg(p_name, ',' ORDER BY p_partkey) AS s FROM p GROUP BY p_type)
SELECT 'ORD-7' AS code, (SELECT string_agg(s, ' ' ORDER BY s) FROM t) AS tags, (SELECT min('http://h.example/' || l_partkey || '/' || l_suppkey) FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1) AS badge""")
def record_detail(spark, sf):
    one = _catalog(spark, sf).detail("ord 7")
    shown = F.array_join(F.transform("tag_groups", lambda g: F.concat(g["group"], F.lit("="), F.array_join(F.transform(g["tags"], lambda t: t["name"]), ","))), " ")
    return one.select("code", shown.alias("tags"), F.get(F.get(F.col("link_groups"), F.lit(0))["badges"], F.lit(0))["url"].alias("badge"))


# --- publishing and streams ------------------------------------------------------------------------------------------


@query("""SELECT 'records' AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'before', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT 'changed', count(*), 0 FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' OR o_orderpriority = '2-HIGH' AND o_orderstatus <> 'F'""")
def published_snapshots(spark, sf):
    """Two snapshots under their ids; a dry run and a run with findings leave no trace; the pointer names the last one."""
    root = f"{session_dir(spark)}/published-{uuid.uuid4().hex}"
    old, new = previous(spark, sf).select("code", "title", "number"), incoming(spark, sf).select("code", "title", "number")
    sinks.publish(spark, root, "s1", {"records": old})
    before = sinks.read_current(spark, root, "records")
    log = sinks.log_row(refresh.diff_counts(refresh.diff(old, new)), "s2", refresh.INCREMENTAL, "2024-01-01T00:00:00Z", {})
    codes = sinks.log_codes(refresh.diff(old, new), "s2")
    hashes = [sinks.content_hash(df).first().hash for df in (old, new)]
    if sinks.should_publish(refresh.INCREMENTAL, False, *hashes):
        sinks.publish(spark, root, "s2", {"records": new, "refresh_log": log, "refresh_codes": codes})
    sinks.publish(spark, root, "s3", {"records": old}, dry_run=True)
    sinks.publish(spark, root, "s4", {"records": old}, violations=old)
    sums = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("number").alias("total"))
    changed = sinks.read_current(spark, root, "refresh_codes").agg(F.lit("changed").alias("part"), F.count("*").alias("n"), F.lit(0).cast("bigint").alias("total"))
    return sums(sinks.read_current(spark, root, "records"), "records").unionByName(sums(before, "before")).unionByName(changed)


@query("""WITH d AS (SELECT count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS a, count(*) FILTER (o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F') AS d, count(*) FILTER (o_orderpriority = '2-HIGH' AND o_orderstatus <> 'F') AS u,
count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F') AS r FROM orders) SELECT 'audit: ' || a || ' added, ' || u || ' updated, ' || r || ' retained, ' || d || ' deleted' AS summary FROM d""")
def refresh_log_summary(spark, sf):
    path = f"{session_dir(spark)}/log-{uuid.uuid4().hex}"
    counts = refresh.diff_counts(refresh.diff(previous(spark, sf), incoming(spark, sf)))
    for number, day in ((1, "2024-01-01T00:00:00Z"), (2, "2024-02-01T00:00:00Z")):
        row = counts if number == 2 else counts.select((F.col("added") * 0).alias("added"), "deleted", "updated", "retained")
        sinks.append_log(sinks.log_row(row, f"s{number}", refresh.AUDIT, day, {"sheet": "h"}), path)
    return sinks.human_summary(spark.read.parquet(path))


@query("SELECT DISTINCT 'part-' || o_custkey // 25 AS path, CASE o_custkey // 25 % 4 WHEN 1 THEN 'different' WHEN 2 THEN 'missing' WHEN 3 THEN 'extra' END AS state FROM orders WHERE o_custkey // 25 % 4 > 0")
def compared_manifests(spark, sf):
    """Folders of files written from the orders, hashed file by file and compared."""
    root = f"{session_dir(spark)}/files-{uuid.uuid4().hex}"
    rows = orders(spark, sf).withColumn("f", F.expr("prefix div 25"))
    for side, skip in (("a", 3), ("b", 2)):
        value = F.concat("code", F.when((F.lit(side) == "b") & (F.col("f") % 4 == 1), "!").otherwise(""))
        sinks.write_lines(rows.where(F.col("f") % 4 != skip).select("f", value.alias("value")), "f", f"{root}/{side}")
    found = {}
    for side in ("a", "b"):
        listed = sinks.file_manifest(spark, f"{root}/{side}").where("path like 'f=%'")
        found[side] = listed.select(F.concat(F.lit("part-"), F.regexp_extract("path", "f=([0-9]+)", 1)).alias("path"), "hash")
    return sinks.compare_manifests(found["a"], found["b"])


@query("SELECT o_custkey AS prefix, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def exported_lines(spark, sf):
    """K1: the exported lines, read back, hold every group with its records in order."""
    rows = orders(spark, sf).select("code", "prefix", "number", "title", "release_date")
    lines = sinks.document_lines(rows, records.build_groups(rows), {"schemaVersion": 1})
    read = lines.select(F.from_json("value", "code bigint, count bigint, videos array<struct<number:bigint>>").alias("g")).where("g.code is not null")
    return read.select(F.col("g.code").alias("prefix"), F.size("g.videos").cast("bigint").alias("n"), F.get("g.videos.number", F.lit(0)).alias("first"), F.element_at("g.videos.number", -1).alias("last"))


@query(f"WITH {_BRIDGE} SELECT 'core' AS part, count(*) AS n FROM orders UNION ALL SELECT 'assignments', count(DISTINCT code) FROM bridge JOIN orders ON code = 'ORD-' || o_orderkey UNION ALL SELECT 'columns', 2")
def split_tables(spark, sf):
    ids = bridge(spark, sf).groupBy("code").agg(F.sort_array(F.collect_set("tag_id")).alias("tag_ids"))
    rows = orders(spark, sf).select("code", "title").join(ids, "code", "left").withColumns({c: F.lit("x") for c in tags.TAG_FIELDS if c != "tag_ids"})
    core, own = tags.split_runtime(rows)
    n = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return n(core, "core").unionByName(n(own, "assignments")).unionByName(spark.range(1).select(F.lit("columns").alias("part"), F.lit(len(core.columns)).cast("bigint").alias("n")))


def _stream(spark, sf, files: int):
    rows = _t(spark, sf, "events")
    base_dir = f"{session_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.repartition(files, F.xxhash64("event_id")).write.parquet(f"{base_dir}/landed")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base_dir}/landed"), base_dir


@query("SELECT DISTINCT user_id FROM events")
def stream_new_records(spark, sf):
    """Over several batches each user comes through once within a watermark that spans the table."""
    rows, out = _stream(spark, sf, 4)
    fresh = streaming.new_records(rows.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "ts", "3650 days", "user_id")
    fresh.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, ts timestamp").parquet(f"{out}/out").select("user_id")


@query("SELECT event_type AS gate, count(*) AS n FROM events WHERE value > 100 GROUP BY 1")
def stream_gate_totals(spark, sf):
    """Per batch counts of rows that break a rule, here a value over 100 by type, summed over batches."""
    rows, out = _stream(spark, sf, 4)
    rule = lambda df: df.where("value > 100").select(F.col("event_type").alias("gate"))
    streaming.stream_gate_counts(rows, rule, f"{out}/gates", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/gates").groupBy("gate").agg(F.sum("n").alias("n"))


@query("SELECT min(event_id) AS event_id, user_id FROM events WHERE user_id % 3 > 0 GROUP BY user_id")
def unseen_records(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_id")
    return streaming.unseen_batch(rows, rows.where("user_id % 3 = 0").select("user_id"), "event_id", "user_id").select("event_id", "user_id")
