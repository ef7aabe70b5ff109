"""Registered queries over what is kept between refreshes: documents, versions, hash trees, indexes, keyset pages, runs of slots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recordkeep.functions import keys
from recordkeep.operators import browse, gates, records, refresh, spread, tags
from recordkeep.operators.search_index import SearchIndex
from recordkeep.plans.lineage import cut, session_dir
from recordkeep.queries import _LINKS, SQL, _t, bridge, incoming, one_leaf, orders, parts, previous, query
from recordkeep.queries_merge import _catalog
from recordkeep.sources import documents, hash_tree, sheets, sinks, versions
from recordkeep.streaming import keyed


def _folder(spark, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- documents ---------------------------------------------------------------------------------------------------------


def _tables(spark, sf) -> documents.Tables:
    own = orders(spark, sf)
    k = F.col("number")
    records = own.select(
        "code", F.concat(F.lit("C"), F.col("prefix").cast("string")).alias("prefix"), "number", F.when(k % 7 != 1, F.concat(F.lit('"'), "title", F.lit('"\n'))).alias("title"),
        F.when(k % 3 != 0, F.array("title", F.lit("é"))).alias("actors"), "release_date", F.lit(None).cast("string").alias("cover"), "product_id", F.lit(None).cast("string").alias("preview_base"),
        (k % 90 + 1).cast("int").alias("preview_count"), F.array(k + 1, k + 2).alias("tag_ids"), F.lit("complete").alias("tags_status"), F.lit(None).cast("string").alias("tags_updated_at"), F.lit("official").alias("tags_source"),
    )
    links = one_leaf(spark, sf, "R").join(own.select("code"), "code", "left_semi").withColumn("scope", F.when(F.col("provider") > "p3", "uncensored").otherwise(""))
    shared = records.where("prefix LIKE '%1'").select("prefix").distinct().select("prefix", F.lit("subtitle").alias("provider"), F.concat(F.lit("http://d/"), "prefix").alias("url"))
    tags = parts(spark, sf).select("id", "group", "name", F.concat(F.lit("T"), "name").alias("translation"), F.lit(1).cast("bigint").alias("count"))
    header = own.agg(F.count("*").alias("n")).select(F.lit(1).alias("schemaVersion"), F.lit("2024-01-01T00:00:00Z").alias("generatedAt"), F.create_map(F.lit("records"), F.col("n")).alias("totals"), F.lit("audit").alias("refresh"), F.create_map(F.lit("label"), F.lit("portal")).alias("resources"))
    return documents.Tables(header, records, links, shared, tags)


_DOC = """'C' || o_custkey || '|' || o_orderkey || '|' || CASE WHEN o_orderkey % 7 <> 1 THEN '"' || o_orderpriority || '"' || chr(10) ELSE '-' END || '|' || CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority || ',é' ELSE '-' END || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|'
|| CASE WHEN o_orderstatus <> 'P' THEN o_orderkey || '' ELSE '-' END || '|' || (o_orderkey % 90 + 1) || '|' || (o_orderkey + 1) || ',' || (o_orderkey + 2)"""


@query(f"""{_LINKS} SELECT 'record' AS part, 'ORD-' || o_orderkey AS key, {_DOC} AS value FROM orders
UNION ALL SELECT 'link', code || CASE WHEN provider > 'p3' THEN ':uncensored:' ELSE '::' END || provider, url FROM old WHERE code IN (SELECT 'ORD-' || o_orderkey FROM orders)
UNION ALL SELECT DISTINCT 'group', 'C' || o_custkey, 'http://d/C' || o_custkey FROM orders WHERE ('' || o_custkey) LIKE '%1' UNION ALL SELECT 'tag', '' || p_partkey, 'T' || p_name FROM part UNION ALL SELECT 'header', '1', '' || count(*) FROM orders""")
def document_round_trip(spark, sf):
    """The catalogue exported as a document in parts and read again."""
    path = _folder(spark, "document")
    documents.export(_tables(spark, sf), path, compression="gzip")
    t = documents.read(spark, path, cut(documents.read_lines(spark, path), "document-read", codec=documents.CODEC))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit("-"))
    value = F.concat_ws("|", "prefix", *[blank(F.col(c)) for c in ("number", "title")], listed(F.col("actors")), "release_date", blank(F.col("product_id")), blank(F.col("preview_count")), listed(F.col("tag_ids").cast("array<string>")))
    out = t.records.select(F.lit("record").alias("part"), F.col("code").alias("key"), value.alias("value"))
    out = out.unionByName(t.links.select(F.lit("link").alias("part"), F.concat_ws(":", "code", "scope", "provider").alias("key"), F.col("url").alias("value")))
    out = out.unionByName(t.group_links.select(F.lit("group").alias("part"), F.col("prefix").alias("key"), F.col("url").alias("value")))
    out = out.unionByName(t.tags.select(F.lit("tag").alias("part"), F.col("id").cast("string").alias("key"), F.col("translation").alias("value")))
    return out.unionByName(t.header.select(F.lit("header").alias("part"), F.col("schemaVersion").cast("string").alias("key"), F.col("totals")["records"].cast("string").alias("value")))


@query(f"""{_LINKS} SELECT 'records' AS part, count(*) AS n, true AS same FROM orders UNION ALL SELECT 'links', count(*), true FROM old WHERE code IN (SELECT 'ORD-' || o_orderkey FROM orders)
UNION ALL SELECT 'group_links', count(DISTINCT o_custkey), true FROM orders WHERE ('' || o_custkey) LIKE '%1' UNION ALL SELECT 'tags', count(*), true FROM part
UNION ALL SELECT 'lines', 1 + (SELECT count(*) + count(DISTINCT o_custkey) FROM orders) + (SELECT count(*) FROM part), true""")
def document_hashes(spark, sf):
    """Hashes of the tables before an export and after reading it, and whether all its lines are there."""
    path, before = _folder(spark, "document"), _tables(spark, sf)
    before.links = cut(before.links, "document-links")  # both exported and hashed
    documents.export(before, path, compression="gzip")
    lines = cut(documents.read_lines(spark, path), "document-read", codec=documents.CODEC)
    after = documents.read(spark, path, lines)
    out = documents.gaps(lines).select(F.lit("lines").alias("part"), F.col("lines").alias("n"), ((F.col("stated") == F.col("lines")) & (F.col("lines") == F.col("places"))).alias("same"))
    for name in ("records", "links", "group_links", "tags"):
        a, b = getattr(before, name), getattr(after, name)
        same = sinks.content_hash(a).first() == sinks.content_hash(b.select(*a.columns)).first()
        out = out.unionByName(b.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.lit(same).alias("same")))
    return out


@query("""SELECT o_orderkey % 4 AS sheet, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS row_no, 'ord_' || o_orderkey || '|' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || chr(10) || chr(10) || 'a, "b"' ELSE '' END || '|' || o_custkey || CASE WHEN o_orderkey % 5 = 0 THEN '|' ELSE '' END AS cells FROM orders""")
def sheet_rows(spark, sf):
    """Sheets with quoted line breaks, commas and quotes, read in splits; row numbers count rows, not lines."""
    path = _folder(spark, "sheets")
    k = F.col("number")
    note = F.when(k % 3 == 0, F.concat(F.lit('"'), "title", F.lit('\n\na, ""b"""'))).otherwise("")
    line = F.concat(F.lit("ord_"), k.cast("string"), F.lit(","), note, F.lit(","), F.col("prefix").cast("string"), F.when(k % 5 == 0, ",").otherwise(""))
    orders(spark, sf).select((k % 4).alias("sheet"), line.alias("value"), "number").repartitionByRange("sheet", "number").sortWithinPartitions("sheet", "number").select("sheet", "value").write.partitionBy("sheet").text(path)
    rows = sheets.read_sheets(spark, path, parts=True)
    return rows.select(F.regexp_extract("file", "sheet=([0-9]+)", 1).cast("bigint").alias("sheet"), F.col("row_no").cast("bigint").alias("row_no"), F.array_join("cells", "|").alias("cells"))


# --- versions and hash trees -------------------------------------------------------------------------------------------


@query("""SELECT 1 AS version, 0 AS parent, 's1' AS snapshot_id, count(*) AS n, sum(o_orderkey)::BIGINT AS total, 0 AS refused FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT 2, 1, 's2', count(*), sum(o_orderkey)::BIGINT, 1 FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 3, 2, 's2', count(*), sum(o_orderkey)::BIGINT, 0 FROM orders""")
def published_versions(spark, sf):
    """Two refreshes of one baseline, of which the second is refused and goes again on top of the first; older versions stay readable."""
    root = _folder(spark, "versions")
    first, second, third = (df.select("code", "number") for df in (previous(spark, sf), incoming(spark, sf), orders(spark, sf)))
    sinks.publish(spark, root, "s1", {"records": first})
    base, refused = versions.latest(spark, root), {}
    sinks.publish(spark, root, "s2", {"records": second}, base=base)
    try:
        sinks.publish(spark, root, "s2", {"records": third}, base=base)
    except versions.Conflict:
        refused[base + 1] = 1
        sinks.publish(spark, root, "s2", {"records": third})
    out = None
    for v in versions.history(spark, root):  # three here
        rows = versions.read(spark, root, v["version"], "records").agg(F.count("*").alias("n"), F.sum("number").alias("total"))
        one = rows.select(F.lit(v["version"]).alias("version"), F.lit(v["parent"]).alias("parent"), F.lit(v["snapshot_id"]).alias("snapshot_id"), "n", "total", F.lit(refused.get(v["version"], 0)).alias("refused"))
        out = one if out is None else out.unionByName(one)
    return out


def _saved(spark, sf):
    """The previous snapshot and one that lost, gained and changed some of its records, by bucket; (old, new, schema, new rows)."""
    day = F.col("release_date")
    old = previous(spark, sf).select("code", "title", day.alias("day"), "number")
    changed = old.where("number % 400 <> 7").withColumn("title", F.when(F.col("number") % 500 == 3, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    more = orders(spark, sf).where("title = '1-URGENT' and number % 300 = 1").select("code", "title", day.alias("day"), "number")
    new, paths = changed.unionByName(more), []
    for name, df in (("old", old), ("new", new)):
        paths.append(_folder(spark, f"buckets-{name}"))
        hash_tree.save(df, ["code"], paths[-1])
    return (*paths, old.withColumn("bucket", F.lit(0)).schema, old, new)


_CHANGED = """SELECT 'ORD-' || o_orderkey AS code, CASE WHEN o_orderpriority = '1-URGENT' THEN 'added' WHEN o_orderkey % 400 = 7 THEN 'deleted' WHEN o_orderkey % 500 = 3 THEN 'updated' ELSE 'retained' END AS change
FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderkey % 300 = 1"""


@query(f"SELECT * FROM ({_CHANGED}) WHERE change <> 'retained'")
def diff_by_buckets(spark, sf):
    """Changes between two snapshots, read from the buckets whose hashes differ."""
    old, new, schema, _, _ = _saved(spark, sf)
    return hash_tree.changes(spark, old, new, schema)


@query(f"SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'retained') AS retained, true AS as_whole, true AS rebuilt FROM ({_CHANGED})")
def bucket_counts(spark, sf):
    """The same as counters; equal to those of a whole diff, and the tree of the rows read again is the tree saved."""
    old, new, schema, a, b = _saved(spark, sf)
    own = hash_tree.counts(spark, new, hash_tree.changes(spark, old, new, schema))
    whole = refresh.diff_counts(refresh.diff(a, b)).first()
    again = hash_tree.tree(hash_tree.rows_of(spark, new, schema)).where("level = 0").first().hash == hash_tree.root(spark, new)
    equal = F.lit(True)
    for c in ("added", "deleted", "updated", "retained"):
        equal = equal & (F.col(c) == whole[c])
    return own.select("added", "deleted", "updated", "retained", equal.alias("as_whole"), F.lit(again).alias("rebuilt"))


# --- search, pages, slots, tags ------------------------------------------------------------------------------------------


@query(SQL["catalog_search"])
def indexed_search(spark, sf):
    """The catalogue's search by posting lists."""
    index = SearchIndex.write(_catalog(spark, sf), _folder(spark, "index"))
    found = index.search(" Ｓtandard   SMALL").join(_catalog(spark, sf).groups.select("prefix", "latest_date"), "prefix")
    return spread.placed(found, [F.desc("latest_date"), F.col("prefix"), F.col("number")]).select("code", "place")


@query("""WITH h AS (SELECT p_partkey AS id, lower(p_type || ' ' || p_name) AS h FROM part) SELECT q, count(*) AS n, sum(id)::BIGINT AS total FROM h, (VALUES ('widget'), ('all rin'), ('e'), ('no such name')) v(q) WHERE contains(h, q) GROUP BY q""")
def indexed_needles(spark, sf):
    """Needles of a posting list, of several trigrams, under three characters (a scan), and one that stands nowhere."""
    p = parts(spark, sf)
    rows = p.select(F.concat(F.lit("P-"), F.col("id").cast("string")).alias("code"), F.lit("P").alias("prefix"), F.col("id").alias("number"), F.concat_ws(" ", "group", "name").alias("title"), F.array().cast("array<string>").alias("actors"), F.lit("2024-01-01").alias("release_date"), F.array().cast("array<bigint>").alias("tag_ids"))
    index = SearchIndex.write(browse.Catalog(rows, records.build_groups(rows), p.withColumn("translation", F.col("name")).limit(0), None), _folder(spark, "index"))
    out = None
    for wanted in ("widget", "all rin", "e", "no such name"):
        # the codes and the prefix, all "p", hold an e nowhere
        one = index.search(wanted).groupBy(F.lit(wanted).alias("q")).agg(F.count("*").alias("n"), F.sum("number").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH r AS (SELECT 'ORD-' || o_orderkey AS code, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT s AS start, code, pos FROM r, (VALUES (0), (990), (4321)) v(s) WHERE pos >= s AND pos < s + 100 UNION ALL SELECT n - 30, code, pos FROM r WHERE pos >= n - 30""")
def keyset_pages(spark, sf):
    """Pages of one written order, each read from its own chunks; the second lies across two of them, the last is short."""
    pages = spread.Pages.write(orders(spark, sf).select("code", "number", "release_date"), [F.desc("release_date"), F.asc("number")], chunk=1000)
    out = None
    for start in (0, 990, 4321, pages.total - 30):
        rows, place = pages.page(start)
        first = spread.placed(rows, [F.desc("release_date"), F.asc("number")])  # a page
        one = first.select(F.lit(start).cast("bigint").alias("start"), "code", (F.col("place") - 1 + place["start"]).alias("pos"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH r AS (SELECT 'ORD-' || o_orderkey AS code, o_orderkey, o_orderdate FROM orders), last AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER () AS n FROM r) WHERE rn = n // 2)
SELECT code FROM (SELECT r.code, r.o_orderdate AS d, r.o_orderkey AS k FROM r, last WHERE r.o_orderdate < last.o_orderdate OR r.o_orderdate = last.o_orderdate AND r.o_orderkey > last.o_orderkey) ORDER BY d DESC, k LIMIT 80""")
def page_after_key(spark, sf):
    """The page behind the last row of another, found by its key."""
    pages = spread.Pages.write(orders(spark, sf).select("code", "number", "release_date"), [F.desc("release_date"), F.asc("number")], chunk=1000)
    seen = pages.page(pages.total // 2 - 100, 100)[0].orderBy("release_date", F.desc("number")).first()
    beyond = (F.col("release_date") < seen.release_date) | ((F.col("release_date") == seen.release_date) & (F.col("number") > seen.number))
    return pages.after(beyond, 80).select("code")


_SLOTTED = """SELECT 'C' || o_custkey AS prefix, CASE WHEN o_orderkey % 40 = 7 THEN NULL WHEN o_orderkey % 40 = 9 THEN 9223372036854775807 WHEN o_orderkey % 40 = 11 THEN 0 WHEN o_orderkey % 40 = 13 THEN 1000000000000 ELSE (o_orderkey * 7) % 30 END AS number, 'ORD-' || o_orderkey AS code FROM orders"""


@query(f"""WITH r AS ({_SLOTTED}), f AS (SELECT prefix, number, min(code) AS code FROM r WHERE number < 9223372036854775807 GROUP BY ALL), g AS (SELECT prefix, greatest(99, max(number) FILTER (number < 9223372036854775807)) AS reach FROM r GROUP BY prefix),
p AS (SELECT prefix, number, lag(number, 1, 0) OVER (PARTITION BY prefix ORDER BY number) AS b FROM f WHERE number > 0), m AS (SELECT prefix, max(number) AS top FROM p GROUP BY prefix)
SELECT prefix, number AS first, number AS last, code, false AS gap FROM f UNION ALL SELECT prefix, b + 1, number - 1, NULL, true FROM p WHERE number > b + 1
UNION ALL SELECT g.prefix, coalesce(top, 0) + 1, 99, NULL, true FROM g LEFT JOIN m USING (prefix) WHERE coalesce(top, 0) < 99""")
def slot_runs(spark, sf):
    """Slots as runs: numbers that are missing, 0, repeated, absent, and of a million millions."""
    return spread.slot_runs(_slotted(spark, sf))


def _slotted(spark, sf):
    return _t(spark, sf, "orders").selectExpr(*["'C' || o_custkey AS prefix", "CASE WHEN o_orderkey % 40 = 7 THEN NULL WHEN o_orderkey % 40 = 9 THEN 9223372036854775807 WHEN o_orderkey % 40 = 11 THEN 0 WHEN o_orderkey % 40 = 13 THEN 1000000000000 ELSE (o_orderkey * 7) % 30 END AS number", "'ORD-' || o_orderkey AS code"])


@query(f"""WITH r AS ({_SLOTTED}), w AS (SELECT prefix FROM r WHERE number = 1000000000000 ORDER BY prefix LIMIT 1), f AS (SELECT number, min(code) AS code FROM r WHERE prefix = (SELECT prefix FROM w) AND number < 9223372036854775807 GROUP BY number),
z AS (SELECT count(*) FILTER (number = 0) AS z FROM f), n AS (SELECT range + 3 - z AS number FROM range(40), z UNION ALL SELECT range + 999999999996 FROM range(5))
SELECT number, code, code IS NULL AS gap FROM n LEFT JOIN f USING (number)""")
def slot_pages(spark, sf):
    """Two pages of the slots of a group that reaches to a million millions: near the front, and the last."""
    rows = _slotted(spark, sf)
    prefix = rows.where("number = 1000000000000").agg(F.min("prefix")).first()[0]
    c = browse.Catalog(rows, None, None, None)
    front, place = c.group_page(prefix, 2, 40, with_gaps=True)
    return front.unionByName(c.group_page(prefix, place["total"] - 5, 100, with_gaps=True)[0]).select("number", "code", "gap")


@query("""WITH b AS (SELECT DISTINCT 'ORD-' || l_orderkey AS code, l_suppkey AS id FROM lineitem) SELECT code, string_agg(s_name, ',' ORDER BY id DESC) AS tags FROM b JOIN supplier ON s_suppkey = id WHERE s_suppkey % 5 <> 2 GROUP BY code""")
def looked_up_tags(spark, sf):
    """Each record's ids as definitions, in the record's order, unknown ones dropped."""
    ids = bridge(spark, sf).groupBy("code").agg(F.sort_array(F.collect_set("tag_id"), False).alias("tag_ids"))
    named = _t(spark, sf, "supplier").where("s_suppkey % 5 <> 2").select(F.col("s_suppkey").alias("id"), F.lit("genre").alias("group"), F.col("s_name").alias("name"))
    return tags.tag_lookup(ids, named).select("code", F.array_join(F.transform("tags", lambda t: t["name"]), ",").alias("tags"))


@query("SELECT 'C' || o_custkey AS prefix FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 3) > 1")
def repeated_groups(spark, sf):
    """Groups that a directory names with more than one target; the same target twice is one."""
    rows = orders(spark, sf).where("status <> 'P'")
    target = F.concat(F.lit("https://drive.google.com/file/d/x"), (F.col("number") % 3).cast("string"))
    cells = rows.select(F.concat(F.lit(" c"), F.col("prefix").cast("string")).alias("text"), F.lit("#F00").alias("color"), target.alias("href"), F.lit(None).cast("string").alias("anchor"))
    return sheets.repeated_groups(sheets.directory_links(cells, "#ff0000"))


@query("""SELECT id, row_number() OVER (ORDER BY n DESC, lower(name), name = upper(name), id) AS place FROM (SELECT p_partkey AS id, p_size AS n, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) ELSE p_name END AS name FROM part)""")
def collated_tags(spark, sf):
    """Tags by count, then name in a language's order, where letters come before case; the binary order would set capitals first."""
    rows = _t(spark, sf, "part").selectExpr("p_partkey AS id", "cast(p_size AS bigint) AS n", "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) ELSE p_name END AS name")
    return spread.placed(rows, tags.tag_order(F.col("name"), "zh")).select("id", "place")


@query("SELECT 'blank' AS query, 0 AS n UNION ALL SELECT 'name', count(*) FROM part WHERE contains(lower(p_type || ' ' || p_name), 'widget')")
def blank_tag_search(spark, sf):
    """Q3: a blank query finds no tag."""
    c = _catalog(spark, sf)
    n = lambda df, name: df.agg(F.lit(name).alias("query"), F.count("*").alias("n"))
    return n(c.search_tags(" 　 "), "blank").unionByName(n(c.search_tags("widget"), "name"))


@query("""SELECT 'same' AS pair, true AS content, true AS exact UNION ALL SELECT 'commit', true, false UNION ALL SELECT 'files', false, false UNION ALL SELECT 'field', false, false""")
def release_identity(spark, sf):
    """K7: manifests of the orders' rows, equal, under another commit, of other rows, and with a field more."""
    held = orders(spark, sf).select(F.col("code").alias("path"), F.sha2(F.concat_ws("|", "title", "release_date"), 256).alias("hash"))

    def head(files, commit, extra=None):
        rows = sinks.manifest_hash(files).select(F.lit("files").alias("field"), F.col("hash").alias("value"))
        for field, value in [("commit", commit), *([extra] if extra else [])]:
            rows = rows.unionByName(spark.range(1).select(F.lit(field).alias("field"), F.lit(value).alias("value")))
        return rows

    own = head(held, "a")
    pairs = {"same": head(held.repartition("path"), "a"), "commit": head(held, "b"), "files": head(held.where("path <> 'ORD-7'"), "a"), "field": head(held, "a", ("config", "x"))}
    out = [sinks.same_release(own, other).select(F.lit(name).alias("pair"), "content", "exact") for name, other in pairs.items()]
    return gates.union(out)


@query("""WITH o AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F') SELECT m AS mode, n FROM o, (VALUES ('incremental'), ('audit'), ('audit in bounds'), ('links-only')) v(m)""")
def retain_without_previous(spark, sf):
    """Without previous records the incoming ones are all there is, in every mode."""
    new, old = incoming(spark, sf), previous(spark, sf).where(F.lit(False))
    modes = {"incremental": refresh.Refresh(), "audit": refresh.Refresh(refresh.AUDIT, True), "audit in bounds": refresh.Refresh(refresh.AUDIT, True, number_from=10, number_to=20), "links-only": refresh.Refresh(refresh.LINKS_ONLY)}
    return gates.union([refresh.retain(new, old, how).agg(F.lit(name).alias("mode"), F.count("*").alias("n")) for name, how in modes.items()])


_WIDE = "translate(o_orderkey::VARCHAR, '0123456789', '０１２３４５６７８９')"


@query(f"SELECT 'ord　' || {_WIDE} AS typed, 'ORD-' || o_orderkey AS code, 'ORD-' || o_orderkey || 'B' AS found FROM orders")
def unicode_codes(spark, sf):
    """Full-width digits and an ideographic space are digits and space."""
    wide = F.translate(F.col("number").cast("string"), "0123456789", "０１２３４５６７８９")
    rows = orders(spark, sf).select(F.concat(F.lit("ord　"), wide).alias("typed"), F.concat(F.lit("見よ ord　-　"), wide, F.lit("b 。")).alias("prose"))
    return rows.select("typed", keys.normalize_code(F.col("typed")).alias("code"), keys.extract_code(F.col("prose")).alias("found"))


# --- streams -------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT user_id FROM events WHERE user_id % 3 > 0")
def stream_unseen_keyed(spark, sf):
    """Eight batches, half of them after a restart, against a snapshot that holds a third of the users and grows by what comes."""
    rows = _t(spark, sf, "events").select("user_id", "event_id")
    base = _folder(spark, "keyed")
    for half in (0, 1):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half).repartition(4, F.xxhash64("event_id", F.lit(1))).write.mode("append").parquet(f"{base}/landed")
        landed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landed")
        known = rows.where("user_id % 3 = 0").select("user_id")
        with keyed.keyed_state(spark):
            run = keyed.unseen_stream(landed, known, "event_id", "user_id").writeStream.option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out").select("user_id")
