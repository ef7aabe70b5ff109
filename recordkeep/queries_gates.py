"""Registered queries for the quality gates: snapshots with planted faults, and what the gates must find in them.

The faults are planted by expressions that both engines read; the findings are stated in SQL rule by rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recordkeep.operators import gates, records, refresh, scans, tags
from recordkeep.queries import _t, bridge, incoming, orders, parts, previous, query
from recordkeep.queries_values import BASE, base, cells_sql, made
from recordkeep.sources import sinks

_HEADS = {
    "schema_version": "CASE WHEN k % 10 = 1 THEN 2 WHEN k % 10 <> 2 THEN 1 END",
    "generated_at": "CASE WHEN k % 9 = 1 THEN day WHEN k % 9 <> 2 THEN day || 'T00:00:00Z' END",
    "mode": "CASE k % 8 WHEN 1 THEN 'other' WHEN 2 THEN 'audit' WHEN 3 THEN 'links-only' WHEN 4 THEN NULL ELSE 'incremental' END",
}


def _counted(found):
    return found.groupBy("gate", "key", "message").agg(F.count("*").alias("n"))


@query(f"""WITH {BASE} SELECT 'G1' AS gate, 'schema_version' AS key, 'must be 1' AS message, count(*) AS n FROM base WHERE k % 10 IN (1, 2)
UNION ALL SELECT 'G1', 'generated_at', 'must be a UTC time ending in Z', count(*) FROM base WHERE k % 9 IN (1, 2) UNION ALL SELECT 'G1', 'mode', 'unknown refresh mode', count(*) FROM base WHERE k % 8 IN (1, 4)""")
def gate_headers(spark, sf):
    return _counted(gates.header(made(base(spark, sf), _HEADS)))


_FAULTY = {
    "code": "'C' || o_custkey || '-' || k",
    "prefix": "'C' || o_custkey",
    "number": "CASE WHEN k % 97 = 5 THEN k + 1 ELSE k END",
    "title": "CASE k % 89 WHEN 3 THEN '  ' WHEN 4 THEN '涓涓' ELSE o_orderpriority END",
    "actor": "CASE k % 71 WHEN 3 THEN ' ' WHEN 4 THEN 'x�' ELSE 'x' END",
    "release_date": "CASE WHEN k % 83 = 2 THEN '2001-2-3' ELSE day END",
    "cover": "CASE k % 79 WHEN 1 THEN 'ftp://x' WHEN 2 THEN NULL ELSE 'https://h.example/db/ord/' || k || '/pac_s.jpg' END",
    "product_id": "CASE k % 73 WHEN 1 THEN -1 - k WHEN 2 THEN k + 2 WHEN 4 THEN NULL ELSE k + 1 END",
    "preview_base": "CASE k % 61 WHEN 1 THEN 'https://h.example/db/ord/other/sample/' WHEN 2 THEN 'http://x' WHEN 3 THEN NULL ELSE 'https://h.example/db/ord/' || k || '/sample/' END",
    "preview_count": "CASE k % 61 WHEN 4 THEN 0 WHEN 5 THEN 100 WHEN 6 THEN NULL ELSE 18 END",
}
_F = f"{BASE}, f AS ({cells_sql(_FAULTY)}), faulty AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE number % 101 = 7)"
_OK_DATE = "strftime(try_strptime(release_date, '%Y-%m-%d'), '%Y-%m-%d') = release_date"


def faulty(spark, sf):
    rows = made(base(spark, sf), _FAULTY)
    return rows.unionByName(rows.where("number % 101 = 7")).withColumn("actors", F.array("actor"))


def _rule(gate: str, message: str, where: str, source: str = "faulty", key: str = "code") -> str:
    return f"SELECT '{gate}' AS gate, {key} AS key, '{message}' AS message FROM {source} WHERE {where}"


def _rules(*rows: str) -> str:
    return " UNION ".join(rows)


@query(f"""WITH {_F} {_rules(
    _rule("G3", "code, prefix and number differ", "code <> prefix || '-' || number"),
    "SELECT 'G3', code, 'duplicate code' FROM faulty GROUP BY code HAVING count(*) > 1",
    _rule("G4", "id is not positive", "product_id <= 0"),
    "SELECT 'G4', product_id::VARCHAR, 'duplicate id: ' || string_agg(DISTINCT code, ', ' ORDER BY code) FROM faulty WHERE product_id IS NOT NULL GROUP BY product_id HAVING count(DISTINCT code) > 1",
)}""")
def gate_codes(spark, sf):
    return gates.codes(faulty(spark, sf)).distinct()


@query(f"""WITH {_F} {_rules(
    _rule("G6", "title is empty", "trim(title) = ''"),
    _rule("G6", "title is damaged", "title = '涓涓'"),
    _rule("G6", "names are missing or damaged", "trim(actor) = '' OR contains(actor, '�')"),
    _rule("G7", "date is not real", f"NOT coalesce({_OK_DATE}, false)"),
    _rule("G7", "date is too early", f"coalesce({_OK_DATE}, false) AND release_date < '1996-01-01'"),
    _rule("G8", "cover is no address", "cover LIKE 'ftp%'"),
)}""")
def gate_texts_dates_covers(spark, sf):
    rows = faulty(spark, sf)
    return gates.union([gates.texts(rows), gates.dates_and_covers(rows, "1996-01-01")]).distinct()


_BASE_OF = "CASE WHEN cover LIKE 'https://h.example/%' THEN replace(cover, 'pac_s.jpg', 'sample/') END"


@query(f"""WITH {_F} {_rules(
    _rule("G11", "base and count must come together", "(preview_base IS NULL) <> (preview_count IS NULL)"),
    _rule("G11", "base is not official", "preview_base = 'http://x'"),
    _rule("G11", "base does not derive from the cover", f"preview_base IS NOT NULL AND preview_base IS DISTINCT FROM {_BASE_OF}"),
    _rule("G11", "count must be 1 to 99", "preview_count NOT BETWEEN 1 AND 99"),
    _rule("G11", "expanded addresses must not be published", "number % 67 = 3"),
)}""")
def gate_previews(spark, sf):
    rows = faulty(spark, sf).withColumn("preview_urls", F.when(F.col("number") % 67 == 3, F.array(F.lit("u"))))
    return gates.previews(rows, "h.example", "db").distinct()


_STATED = {
    "prefix": "CASE WHEN o_custkey % 50 = 9 THEN 'c-' || o_custkey ELSE 'C' || o_custkey END",
    "n": "CASE WHEN o_custkey % 7 = 1 THEN count(*) + 1 ELSE count(*) END",
    "first_date": "CASE WHEN o_custkey % 7 = 2 THEN '1990-01-01' WHEN o_custkey % 7 <> 4 THEN min(day) END",
    "latest_date": "CASE WHEN o_custkey % 7 = 3 THEN '2030-01-01' WHEN o_custkey % 7 <> 5 THEN max(day) END",
}


@query(f"""WITH {_F}, s AS ({cells_sql(_STATED)} GROUP BY o_custkey), stated AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE prefix LIKE 'C11%'),
r AS (SELECT prefix, count(*) AS n, min(release_date) FILTER ({_OK_DATE}) AS a, max(release_date) FILTER ({_OK_DATE}) AS b FROM faulty GROUP BY prefix) {_rules(
    "SELECT 'G2' AS gate, prefix AS key, 'duplicate group' AS message FROM stated GROUP BY prefix HAVING count(*) > 1",
    _rule("G2", "invalid group name", "prefix LIKE 'c-%'", "stated", "prefix"),
    "SELECT 'G2', prefix, 'count differs' FROM stated FULL JOIN r USING (prefix) WHERE stated.n IS DISTINCT FROM r.n",
    "SELECT 'G12', prefix, 'first date differs' FROM stated JOIN r USING (prefix) WHERE a IS NOT NULL AND first_date IS DISTINCT FROM a",
    "SELECT 'G12', prefix, 'latest date differs' FROM stated JOIN r USING (prefix) WHERE b IS NOT NULL AND latest_date IS DISTINCT FROM b",
)}""")
def gate_groups(spark, sf):
    rows = base(spark, sf).groupBy("o_custkey").agg(F.expr(f"{_STATED['n']} AS n"), F.expr(f"{_STATED['first_date']} AS first_date"), F.expr(f"{_STATED['latest_date']} AS latest_date"))
    stated = rows.selectExpr(f"{_STATED['prefix']} AS prefix", "n", "first_date", "latest_date")
    return gates.groups(stated.unionByName(stated.where("prefix like 'C11%'")), faulty(spark, sf)).distinct()


@query(f"""WITH {BASE}, r AS (SELECT 'C' || o_custkey AS prefix, CASE WHEN k % 40 = 3 THEN k + 1000000 ELSE k END AS number, 'x' || k AS code, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS place FROM base),
g AS (SELECT 'C' || o_custkey AS prefix, CASE WHEN o_custkey % 20 = 3 THEN '1990-01-01' WHEN o_custkey % 20 <> 4 THEN max(day) END AS latest_date, row_number() OVER (ORDER BY max(day) DESC, 'C' || o_custkey) AS place FROM base GROUP BY o_custkey),
h AS (SELECT *, lag(latest_date) OVER (ORDER BY place) AS d, lag(prefix) OVER (ORDER BY place) AS p FROM g WHERE latest_date IS NOT NULL),
q AS (SELECT *, lag(number) OVER (PARTITION BY prefix ORDER BY place) AS b, lag(code) OVER (PARTITION BY prefix ORDER BY place) AS c FROM r)
SELECT 'G5' AS gate, prefix AS key, 'group is out of order' AS message FROM h WHERE d < latest_date OR d = latest_date AND p > prefix
UNION ALL SELECT 'G5', code, 'record is out of order' FROM q WHERE b > number OR b = number AND c > code
UNION ALL SELECT 'G5', id::VARCHAR, 'tag is out of order' FROM (SELECT id, lag(id) OVER (ORDER BY place) AS b FROM (SELECT p_partkey AS place, CASE p_partkey % 30 WHEN 7 THEN p_partkey + 1000000 WHEN 9 THEN p_partkey - 1 WHEN 11 THEN -1 ELSE p_partkey END AS id FROM part) WHERE id > 0) WHERE b >= id""")
def gate_order(spark, sf):
    own = base(spark, sf)
    w = records.Window.partitionBy("o_custkey").orderBy("k")
    rows = own.select(F.expr("'C' || o_custkey AS prefix"), F.expr("CASE WHEN k % 40 = 3 THEN k + 1000000 ELSE k END AS number"), F.expr("'x' || k AS code"), F.row_number().over(w).alias("place"))
    from recordkeep.operators import browse

    groups = own.groupBy("o_custkey").agg(F.max("day").alias("d")).selectExpr("'C' || o_custkey AS prefix", "d", "CASE WHEN o_custkey % 20 = 3 THEN '1990-01-01' WHEN o_custkey % 20 <> 4 THEN d END AS latest_date")
    placed = browse.placed(groups, [F.desc("d"), F.col("prefix")])
    named = _t(spark, sf, "part").selectExpr("p_partkey AS place", "CASE p_partkey % 30 WHEN 7 THEN p_partkey + 1000000 WHEN 9 THEN p_partkey - 1 WHEN 11 THEN -1 ELSE p_partkey END AS id")
    return gates.order(placed, rows, named)


_LEAF = {
    "code": "'ORD-' || l_orderkey",
    "scope": "CASE WHEN l_returnflag = 'R' THEN 'uncensored' WHEN l_returnflag = 'A' THEN '' WHEN l_quantity < 3 THEN 'odd' ELSE '' END",
    "provider": "CASE l_linenumber WHEN 1 THEN 'streamtape' WHEN 2 THEN 'player4me' WHEN 3 THEN 'gofile' WHEN 4 THEN 'subtitle' WHEN 5 THEN 'gofile' ELSE 'strange' END",
    "url": "CASE WHEN l_partkey % 50 = 1 THEN '' WHEN l_partkey % 50 = 2 THEN 'http://a b' ELSE 'http://h/' || l_suppkey END",
}


@query(f"""WITH {BASE}, l AS ({cells_sql(_LEAF, 'lineitem')}) {_rules(
    _rule("G9", "unknown scope or provider", "scope = 'odd' OR provider = 'strange' OR scope = 'uncensored' AND provider = 'subtitle'", "l"),
    _rule("G9", "invalid address", "url = '' OR url = 'http://a b'", "l"),
    _rule("G10", "no link", "'ORD-' || k NOT IN (SELECT code FROM l WHERE provider = 'gofile')", "base", "'ORD-' || k"),
    "SELECT 'G10', 'conflicts', '2 conflicts'",
)}""")
def gate_links(spark, sf):
    leaf = made(_t(spark, sf, "lineitem"), _LEAF)
    return gates.union([gates.link_shape(leaf), gates.strict_links(orders(spark, sf), leaf.where("provider = 'gofile'"), 2)]).distinct()


_SHARED = {
    "prefix": "'C' || o_custkey",
    "provider": "CASE WHEN k % 10 = 1 THEN 'gofile' ELSE 'subtitle' END",
    "url": "CASE k % 11 WHEN 1 THEN 'http://x/' || k WHEN 2 THEN 'https://docs.google.com/spreadsheets/d/s/edit' ELSE 'https://drive.google.com/file/d/x' || k END",
}


@query(f"""WITH {BASE}, s AS ({cells_sql(_SHARED)}) {_rules(
    _rule("G13", "only a direct subtitle link is allowed", "provider <> 'subtitle' OR url NOT LIKE '%drive.google%'", "s", "prefix"),
    _rule("G13", "unknown resource", "k % 13 = 1", "base", "CASE WHEN k % 13 = 1 THEN 'odd' ELSE 'subtitleDirectory' END"),
    _rule("G13", "must hold label and url alone", "k % 17 IN (1, 2)", "base", "CASE WHEN k % 13 = 1 THEN 'odd' ELSE 'subtitleDirectory' END"),
    _rule("G13", "label is wrong", "k % 17 = 1 OR k % 19 = 1", "base", "CASE WHEN k % 13 = 1 THEN 'odd' ELSE 'subtitleDirectory' END"),
    _rule("G13", "invalid address", "k % 23 = 1", "base", "CASE WHEN k % 13 = 1 THEN 'odd' ELSE 'subtitleDirectory' END"),
)}""")
def gate_group_links(spark, sf):
    own = base(spark, sf)
    name = "CASE WHEN k % 13 = 1 THEN 'odd' ELSE 'subtitleDirectory' END AS name"
    label, url = "CASE WHEN k % 19 = 1 THEN 'other' ELSE 'L' END", "CASE WHEN k % 23 = 1 THEN 'x' ELSE 'http://u' END"
    fields = F.expr(f"CASE k % 17 WHEN 1 THEN map('url', {url}) WHEN 2 THEN map('label', {label}, 'url', {url}, 'more', 'x') ELSE map('label', {label}, 'url', {url}) END")
    return gates.union([gates.group_links(made(own, _SHARED)), gates.resources(own.select(F.expr(name), fields.alias("fields")), "L")]).distinct()


_DEFINED = {
    "id": "s_suppkey",
    "name": "CASE WHEN s_nationkey = 3 THEN ' ' ELSE s_name END",
    "translation": "CASE WHEN s_nationkey <> 5 THEN 'T' || s_name END",
    "grp": "CASE s_nationkey % 9 WHEN 1 THEN 'nonsense' WHEN 2 THEN 'character' WHEN 4 THEN NULL ELSE 'genre' END",
}
_TAG_RECORD = {
    "tags_status": "CASE WHEN k % 8 = 1 THEN 'unavailable' WHEN k % 8 <> 2 THEN 'complete' END",
    "tags_updated_at": "CASE WHEN k % 9 = 1 THEN 'x' WHEN k % 9 <> 2 THEN '2024-01-01T00:00:00Z' END",
    "tags_source": "CASE k % 7 WHEN 1 THEN 'anything' WHEN 2 THEN NULL WHEN 3 THEN 'official-unavailable' ELSE 'official' END",
}


@query(f"""WITH b AS (SELECT DISTINCT 'ORD-' || l_orderkey AS code, l_suppkey AS tag_id FROM lineitem), a AS (SELECT code, list(tag_id ORDER BY tag_id) AS ids FROM b GROUP BY code),
r AS (SELECT 'ORD-' || k AS code, k, CASE WHEN k % 20 = 1 THEN list_reverse(ids) WHEN k % 20 = 2 AND ids IS NOT NULL THEN list_append(ids, ids[len(ids)]) WHEN k % 20 <> 3 THEN ids END AS ids, {", ".join(f"{e} AS {n}" for n, e in _TAG_RECORD.items())} FROM (SELECT o_orderkey AS k, ids FROM orders LEFT JOIN a ON a.code = 'ORD-' || o_orderkey)),
d AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _DEFINED.items())} FROM supplier WHERE s_suppkey % 5 <> 2), d2 AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE id % 11 = 1), known AS (SELECT * FROM d2 WHERE id > 0),
p AS (SELECT DISTINCT code, unnest(ids) AS id FROM r), n AS (SELECT id, count(*) AS n FROM p GROUP BY id), c AS (SELECT DISTINCT known.id, coalesce(n, 0) AS n FROM known LEFT JOIN n ON n.id = known.id),
s AS (SELECT id, CASE id % 10 WHEN 1 THEN n + 1 WHEN 3 THEN NULL WHEN 4 THEN -1 ELSE n END AS stated FROM c WHERE id % 10 <> 5)
SELECT 'G14' AS gate, code AS key, 'tag ids must be unique and sorted' AS message FROM r WHERE len(ids) > 1 AND k % 20 = 1 OR len(ids) > 0 AND k % 20 = 2
UNION SELECT 'G14', code, 'unknown tag ' || id FROM p WHERE id NOT IN (SELECT id FROM known)
UNION SELECT 'G14', id::VARCHAR, 'id must be positive' FROM d WHERE id <= 0
UNION SELECT 'G14', id::VARCHAR, 'duplicate tag' FROM known GROUP BY id HAVING count(*) > 1
UNION SELECT 'G14', id::VARCHAR, 'unknown group' FROM known WHERE grp IS NULL OR grp NOT IN ('genre', 'character')
UNION SELECT 'G14', id::VARCHAR, 'both names are needed' FROM known WHERE trim(name) = '' OR translation IS NULL
UNION SELECT 'G14', c.id::VARCHAR, 'count must be stated and not negative' FROM c LEFT JOIN s USING (id) WHERE stated IS NULL OR stated < 0
UNION SELECT 'G14', c.id::VARCHAR, 'count differs' FROM c LEFT JOIN s USING (id) WHERE stated IS DISTINCT FROM n
UNION SELECT 'G14', code, 'status must be complete' FROM r WHERE tags_status IS DISTINCT FROM 'complete'
UNION SELECT 'G14', code, 'time must be a UTC time ending in Z' FROM r WHERE tags_updated_at IS NULL OR tags_updated_at = 'x'
UNION SELECT 'G14', code, 'provenance must be official' FROM r WHERE tags_source IS NULL OR tags_source NOT IN ('official', 'official-unavailable')
UNION SELECT 'G14', code, 'tag ids are missing' FROM r WHERE ids IS NULL""")
def gate_tags(spark, sf):
    """Every rule of definitions, counts and records, each broken somewhere."""
    ids = bridge(spark, sf).groupBy("code").agg(F.sort_array(F.collect_set("tag_id")).alias("ids"))
    k = F.col("k")
    own = orders(spark, sf).withColumn("k", F.col("number")).join(ids, "code", "left")
    listed = F.when(k % 20 == 1, F.reverse("ids")).when(k % 20 == 2, F.concat("ids", F.slice("ids", -1, 1))).when(k % 20 != 3, F.col("ids"))
    rows = own.select("code", listed.alias("tag_ids"), *[F.expr(e).alias(n) for n, e in _TAG_RECORD.items()])
    named = made(_t(spark, sf, "supplier").where("s_suppkey % 5 <> 2"), _DEFINED).withColumnRenamed("grp", "group")
    seen = tags.tag_counts(rows.select("code", F.explode("tag_ids").alias("tag_id")), named.where("id > 0").select("id"))
    i = F.col("id") % 10
    stated = seen.where(i != 5).select("id", F.when(i == 1, F.col("n") + 1).when(i == 4, -1).when(i != 3, F.col("n")).alias("n"))
    return gates.tag_gates(rows, named.unionByName(named.where("id % 11 = 1")), stated, required=True).distinct()


@query("""WITH t AS (SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS groups, (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS linked)
SELECT 'G15' AS gate, 'records' AS key, 'expected ' || records AS message FROM t UNION ALL SELECT 'G15', 'linked', 'expected ' || linked FROM t""")
def gate_totals(spark, sf):
    from recordkeep.queries import leaves

    actual = records.totals(orders(spark, sf), leaves(spark, sf))
    return gates.totals(actual, actual.select("groups", (F.col("records") + 1).alias("records"), F.lit(None).cast("bigint").alias("linked")))


_BLOCK = {
    "key": "'' || k",
    "mode": "CASE k % 7 WHEN 1 THEN 'odd' WHEN 2 THEN 'audit' ELSE 'incremental' END",
    "source_complete": "CASE k % 5 WHEN 1 THEN NULL WHEN 2 THEN false ELSE true END",
    "n": "CASE WHEN k % 31 = 1 THEN -1 ELSE 5 END",
    "digest": "CASE WHEN k % 37 = 1 THEN 'XYZ' ELSE '" + "0" * 64 + "' END",
}


@query(f"""WITH {BASE} {_rules(
    _rule("G16", "unknown refresh mode", "k % 7 = 1", "base", "'' || k"),
    _rule("G16", "mode is not incremental", "k % 7 = 2", "base", "'' || k"),
    _rule("G16", "completeness is not stated", "k % 5 = 1", "base", "'' || k"),
    _rule("G16", "completeness is not true", "k % 5 = 2", "base", "'' || k"),
    _rule("G16", "counters missing: linkConflicts", "k % 29 = 1", "base", "'' || k"),
    _rule("G16", "counters unknown: more", "k % 29 = 2", "base", "'' || k"),
    _rule("G16", "counters not a count: deleted", "k % 31 = 1", "base", "'' || k"),
    _rule("G16", "inputs are no SHA-256: sheet", "k % 37 = 1", "base", "'' || k"),
    _rule("G16", "deleted is not 5", "k % 31 = 1", "base", "'' || k"),
    _rule("G16", "added, updated and retained do not sum up", "k % 41 = 1", "base", "'' || k"),
)}""")
def gate_refresh_blocks(spark, sf):
    names = [c for c in gates.COUNTERS if c not in ("deleted", "linkConflicts", "added")]
    pairs = ", ".join(f"'{c}', 5" for c in names)
    counts = f"map('deleted', CASE WHEN k % 31 = 1 THEN -1 ELSE 5 END, 'added', CASE WHEN k % 41 = 1 THEN 6 ELSE 5 END, {pairs}"
    own = base(spark, sf)
    blocks = own.selectExpr(*[f"{e} AS {c}" for c, e in _BLOCK.items()], f"CASE k % 29 WHEN 1 THEN {counts}) WHEN 2 THEN {counts}, 'linkConflicts', 5, 'more', 1) ELSE {counts}, 'linkConflicts', 5) END AS counts")
    blocks = blocks.withColumn("inputs", F.create_map(F.lit("sheet"), "digest", F.lit("other"), F.lit("1" * 64)))
    expected = spark.range(1).selectExpr("5 AS deleted", "15 AS records")
    return gates.refresh_block(blocks, "incremental", True, expected).distinct()


_BOTH = "p AS (SELECT *, CASE WHEN o_orderpriority = '2-HIGH' THEN 'HIGH' ELSE o_orderpriority END AS now FROM orders WHERE o_orderpriority <> '1-URGENT'), i AS (SELECT * FROM orders WHERE o_orderstatus <> 'F')"


@query(f"""WITH {_BOTH}, m AS (SELECT p.*, i.o_orderkey IS NULL AS gone FROM p LEFT JOIN i USING (o_orderkey)) {_rules(
    _rule("G18", "an incremental refresh deletes nothing", "gone", "m", "'ORD-' || o_orderkey"),
    _rule("G19", "a links-only refresh changes no record", "gone OR now <> o_orderpriority", "m", "'ORD-' || o_orderkey"),
    "SELECT 'G19', 'ORD-' || o_orderkey, 'a links-only refresh changes no record' FROM i WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p)",
    _rule("G20", "deleted without a complete scan", "gone", "m", "'ORD-' || o_orderkey"),
    _rule("G20", "deleted outside the bounds", "gone AND NOT (o_orderdate >= '1997-01-01')", "m", "'ORD-' || o_orderkey"),
)}""")
def gate_deletions(spark, sf):
    old, new = previous(spark, sf), incoming(spark, sf)
    changes = refresh.diff(old, new)
    how = [refresh.Refresh(), refresh.Refresh(refresh.LINKS_ONLY), refresh.Refresh(refresh.AUDIT, False), refresh.Refresh(refresh.AUDIT, True, date_from="1997-01-01")]
    return gates.union([gates.deletions(changes, h, old) for h in how]).distinct()


@query(f"""WITH {_BOTH} SELECT 'G17' AS gate, i.o_orderkey::VARCHAR AS key, 'was ORD-' || i.o_orderkey AS message FROM p JOIN i USING (o_orderkey) WHERE o_orderkey % 10 = 3 AND p.o_orderstatus <> 'P'""")
def gate_remapped(spark, sf):
    now = incoming(spark, sf).withColumn("code", F.when(F.col("number") % 10 == 3, F.concat("code", F.lit("00"))).otherwise(F.col("code")))
    return gates.remapped(previous(spark, sf), now)


@query(f"""WITH {_BOTH}, m AS (SELECT p.o_custkey, i.o_orderkey IS NULL AS gone FROM p LEFT JOIN i USING (o_orderkey)),
g AS (SELECT o_custkey::VARCHAR AS key, count(*) AS n, count(*) FILTER (gone) AS d, 25 AS most FROM m GROUP BY o_custkey UNION ALL SELECT 'all', count(*), count(*) FILTER (gone), 100 FROM m)
SELECT 'G21' AS gate, key, d || ' deleted' AS message FROM g WHERE d / n > 0.15 OR d > most""")
def gate_regression(spark, sf):
    text = lambda df: df.withColumn("prefix", F.col("prefix").cast("string"))
    found = gates.all_violations(gates.Snapshot(text(incoming(spark, sf)).withColumns({"actors": F.array(F.lit("x")), "cover": F.lit(None).cast("string")}), records.build_groups(text(incoming(spark, sf)))), text(previous(spark, sf)), refresh.Refresh(refresh.AUDIT, True))
    return found.where("gate = 'G21'")


_MANIFEST = {
    "state": "CASE k % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'unresolved' ELSE 'child' END",
    "scope": "CASE WHEN k % 6 = 0 THEN 'record' ELSE 'group' END",
    "prefix": "CASE WHEN k % 50 = 7 THEN 'c' || o_custkey ELSE 'C' || o_custkey END",
    "code": "CASE WHEN k % 6 = 0 THEN CASE k % 60 WHEN 6 THEN 'c' || o_custkey || '-' || k WHEN 12 THEN 'D-' || k ELSE 'C' || o_custkey || '-' || k END END",
    "url": "CASE WHEN k % 45 = 9 THEN 'x' WHEN k % 3 = 0 THEN 'https://drive.google.com/file/d/x' || k ELSE 'http://h/' || k END",
}


@query(f"""WITH {BASE}, s AS ({cells_sql(_MANIFEST)}), g AS (SELECT DISTINCT state, prefix FROM s WHERE code IS NULL) {_rules(
    _rule("G23", "group name is not canonical", "prefix LIKE 'c%'", "s", "prefix"),
    _rule("G23", "code is not canonical", "code LIKE 'c%'", "s"),
    _rule("G23", "code is of another group", "code IS NOT NULL AND upper(regexp_extract(code, '^(.*)-', 1)) <> prefix", "s", "prefix"),
    _rule("G23", "resolved source is no shared file", "state = 'resolved' AND url NOT LIKE '%drive%'", "s", "prefix"),
    _rule("G23", "invalid address", "url = 'x'", "s", "prefix"),
    "SELECT 'G23', coalesce(code, prefix), 'repeated source' FROM s GROUP BY state, scope, prefix, code HAVING count(*) > 1",
    "SELECT 'G23', prefix, 'in ' || string_agg(state, ', ' ORDER BY state) FROM g GROUP BY prefix HAVING count(*) > 1",
)}""")
def gate_link_manifest(spark, sf):
    return gates.link_manifest(made(base(spark, sf), _MANIFEST)).distinct()


@query("SELECT 'G23' AS gate, 'ORD-' || l_orderkey AS key, 'not in the catalogue' AS message FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def gate_membership(spark, sf):
    links = _t(spark, sf, "lineitem").select(F.expr("'ORD-' || l_orderkey AS code")).distinct()
    return gates.membership(links, incoming(spark, sf), "code")


@query(f"WITH {_BOTH} SELECT 'G24' AS gate, 'ORD-' || p.o_orderkey AS key, 'changed or lost' AS message FROM p LEFT JOIN i USING (o_orderkey) WHERE i.o_orderkey IS NULL OR p.o_orderpriority <> p.now")
def gate_continuity(spark, sf):
    return gates.continuity(previous(spark, sf).select("code", "title"), incoming(spark, sf).select("code", "title"), "code")


_PAGED = "c AS (SELECT event_id // 3 AS page, user_id, event_type <> 'error' OR event_id % 7 > 0 AS ok FROM events), f AS (SELECT user_id, min(page) AS page FROM c GROUP BY 1), n AS (SELECT page, count(f.user_id) AS new FROM (SELECT DISTINCT page FROM c) LEFT JOIN f USING (page) GROUP BY page), a AS (SELECT page, count(*) AS cards, count(DISTINCT CASE WHEN ok THEN user_id END) AS resolved, count(*) = count(DISTINCT CASE WHEN ok THEN user_id END) AS complete FROM c GROUP BY page)"


def _facts(spark, sf):
    cards = _t(spark, sf, "events").select(F.expr("event_id div 3 AS page"), F.col("user_id").alias("product_id"), F.expr("event_type <> 'error' OR event_id % 7 > 0 AS parsed"))
    new = scans.page_novelty(cards, spark.createDataFrame([], "product_id long"))
    return scans.page_reconciliation(cards).join(new, "page")


@query(f"WITH {_PAGED} SELECT 'G25' AS gate, page::VARCHAR AS key, 'cards and records differ' AS message FROM a WHERE NOT complete")
def gate_listing(spark, sf):
    return gates.listing(_facts(spark, sf))


_SUMMARY = {
    "mode": "CASE k % 17 WHEN 1 THEN 'audit' WHEN 2 THEN NULL ELSE 'incremental' END",
    "stop_reason": "CASE k % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'all_known' WHEN 2 THEN 'page_limit' WHEN 3 THEN 'error' WHEN 4 THEN 'odd' END",
    "errors": "CASE WHEN k % 5 = 3 THEN 1 WHEN k % 19 = 1 THEN -1 WHEN k % 19 <> 2 THEN 0 END",
    "parsed": "CASE WHEN k % 23 = 1 THEN -10 WHEN k % 23 <> 2 THEN 10 END",
    "new": "CASE WHEN k % 7 = 1 THEN 3 ELSE 4 END",
    "known": "6",
    "records": "CASE k % 7 WHEN 2 THEN 9 WHEN 1 THEN 3 ELSE 4 END",
    "pages": "k % 4",
    "cursor": "CASE WHEN k % 13 = 1 THEN 99 WHEN k % 13 = 2 THEN -1 WHEN k % 13 <> 3 THEN k % 4 END",
}


@query(f"""WITH {BASE}, s AS ({cells_sql(_SUMMARY)}), v AS (SELECT 'unknown reason to stop' AS message FROM s WHERE stop_reason = 'odd' OR stop_reason IS NULL
UNION ALL SELECT 'a count is missing or negative' FROM s WHERE errors IS NULL OR errors < 0 OR parsed IS NULL OR parsed < 0
UNION ALL SELECT 'cursor must be over 0' FROM s WHERE cursor IS NULL OR cursor <= 0
UNION ALL SELECT 'another mode' FROM s WHERE mode IS NULL OR mode = 'audit'
UNION ALL SELECT 'errors and reason to stop differ' FROM s WHERE (errors > 0) IS DISTINCT FROM (stop_reason = 'error')
UNION ALL SELECT 'numbers do not add up' FROM s WHERE errors = 0 AND parsed IS DISTINCT FROM new + known
UNION ALL SELECT 'another number of records came' FROM s WHERE errors = 0 AND records <> new
UNION ALL SELECT 'did not end where it says' FROM s WHERE errors = 0 AND (stop_reason = 'empty' AND NOT (pages >= 1 AND cursor = pages) OR stop_reason = 'all_known' AND pages < 2))
SELECT 'G26' AS gate, 'scan' AS key, message, count(*) AS n FROM v GROUP BY message""")
def gate_scans(spark, sf):
    return _counted(gates.scan(made(base(spark, sf), _SUMMARY)))


@query(f"""WITH {BASE}, h AS (SELECT k, CASE WHEN k % 5 = 1 THEN 0 WHEN k % 5 = 2 THEN 2 ELSE 1 END AS codes, k % 7 = 1 AS turned, k % 3 = 1 AS twice FROM base)
SELECT 'G27' AS gate, k::VARCHAR AS key, 'NEW CODE: ' || codes || ' columns' AS message FROM h WHERE codes <> 1
UNION ALL SELECT 'G27', k::VARCHAR, 'NEW CODE must stand before UNCENSORED' FROM h WHERE codes = 1 AND turned UNION ALL SELECT 'G27', k::VARCHAR, 'GOFILE: 2 columns before UNCENSORED' FROM h WHERE codes = 1 AND NOT turned AND twice""")
def gate_sheet_headers(spark, sf):
    one = "CASE k % 5 WHEN 1 THEN array('x') WHEN 2 THEN array('NEW CODE', 'NEW CODE') ELSE array('NEW CODE') END"
    own = "CASE WHEN k % 3 = 1 THEN array('GOFILE', 'GOFILE') ELSE array('GOFILE') END"
    cells = f"CASE WHEN k % 7 = 1 THEN concat(array('UNCENSORED', 'GOFILE'), {one}, array('GOFILE')) ELSE concat({one}, {own}, array('UNCENSORED', 'GOFILE')) END"
    return gates.sheet_headers(base(spark, sf).select(F.col("k").alias("sheet"), F.expr(cells).alias("cells")), providers=("GOFILE",))


_LANDED = {
    "source_url": "CASE k % 5 WHEN 1 THEN 'http://docs.example/d/s?gid=7' WHEN 2 THEN 'https://docs.example/d/other?gid=7' WHEN 3 THEN 'https://docs.example/d/s?gid=8' ELSE 'https://docs.example/d/s?gid=7&k=' || k END",
    "body": "CASE k % 4 WHEN 1 THEN '  <!DOCTYPE html><p>' WHEN 2 THEN '<Body>' ELSE 'code,url' END",
}


@query(f"WITH {BASE}, s AS ({cells_sql(_LANDED)}) {_rules(_rule('G28', 'unexpected source', chr(39).join(['source_url NOT LIKE ', 'https://docs.example/d/s?gid=7&%', '']), 's', 'source_url'), _rule('G28', 'is markup', chr(39).join(['body LIKE ', '%<%', '']), 's', 'source_url'))}")
def gate_sources(spark, sf):
    return gates.sources(made(base(spark, sf), _LANDED), "docs.example", "/d/s", "7").distinct()


_FILES = {
    "path": "CASE k % 40 WHEN 1 THEN '/abs/' || k WHEN 2 THEN 'a/../' || k WHEN 3 THEN 'twice' ELSE 'data/' || k || '.json' END",
    "hash": "CASE WHEN k % 30 = 1 THEN 'ABC' ELSE '" + "0" * 64 + "' END",
}


@query(f"""WITH {BASE}, s AS ({cells_sql(_FILES)}) {_rules(
    _rule("G29", "unsafe path", "path LIKE '/%' OR path LIKE '%..%'", "s", "path"),
    _rule("G29", "is no SHA-256", "hash = 'ABC'", "s", "path"),
    "SELECT 'G29', path, 'repeated path' FROM s GROUP BY path HAVING count(*) > 1",
    "SELECT 'G29', 'index.html', 'required file is missing'",
    "SELECT 'G29', k::VARCHAR, 'missing or unexpected fields' FROM base WHERE k % 6 = 1",
    "SELECT 'G29', k::VARCHAR, 'unexpected version' FROM base WHERE k % 6 = 2",
    "SELECT 'G29', k::VARCHAR, 'hash does not match the files' FROM base WHERE k % 6 = 3",
)}""")
def gate_file_manifests(spark, sf):
    files = made(base(spark, sf), _FILES)
    actual = sinks.manifest_hash(files.select("path", "hash"))
    stated = base(spark, sf).select("k").crossJoin(actual)  # one row
    version, digest = "CASE WHEN k % 6 = 2 THEN '2' ELSE '1' END", "CASE WHEN k % 6 = 3 THEN 'x' ELSE hash END"
    fields = F.expr(f"CASE WHEN k % 6 = 1 THEN map('schemaVersion', {version}, 'hash', {digest}, 'more', '') ELSE map('schemaVersion', {version}, 'hash', {digest}) END")
    manifests = stated.select(F.col("k").alias("key"), fields.alias("fields"))
    return gates.union([gates.manifest_files(files, ("index.html", "data/4.json")), gates.manifest_totals(manifests, ("schemaVersion", "hash"), actual)]).distinct()


@query(f"""WITH {BASE}, f AS ({cells_sql(_FAULTY)}), clean AS (SELECT *, k FROM f JOIN base ON code = 'C' || o_custkey || '-' || k WHERE k % 97 <> 5 AND k % 89 NOT IN (3, 4) AND k % 71 NOT IN (3, 4) AND k % 83 <> 2 AND k % 79 <> 1 AND k % 73 NOT IN (1, 2))
SELECT count(*) AS records, 0::BIGINT AS found FROM clean""")
def baseline_without_predecessor(spark, sf):
    """Records that break no rule are accepted by themselves."""
    good = made(base(spark, sf), {**_FAULTY, "k": "k"}).withColumn("actors", F.array("actor"))
    good = good.where("k % 97 <> 5 AND k % 89 NOT IN (3, 4) AND k % 71 NOT IN (3, 4) AND k % 83 <> 2 AND k % 79 <> 1 AND k % 73 NOT IN (1, 2)").drop("preview_base", "preview_count", "actor", "k")
    groups = records.build_groups(good)
    kept = gates.accepted_baseline(good, groups, "1990-01-01")
    return kept.agg(F.count("*").alias("records")).crossJoin(gates.violations(good, groups, earliest="1990-01-01").agg(F.count("*").alias("found")))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 1")
def conflicting_definitions(spark, sf):
    rows = parts(spark, sf)
    odd = rows.where("id % 3 = 1").withColumn("name", F.concat("name", F.lit(" x")))
    return tags.conflicting_definitions(rows.unionByName(odd).unionByName(rows.where("id % 3 = 2")))
