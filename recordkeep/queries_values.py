"""Registered queries for scalar forms: codes, texts, numbers, addresses, previews, and canonical records.

The inputs are written by expressions over whole tables that Spark and DuckDB both read; what should come out is stated
in SQL without the patterns under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recordkeep.functions import keys, text, urls, values
from recordkeep.operators import records, refresh
from recordkeep.queries import DAY, _t, orders, query

BASE = "base AS (SELECT *, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"


def base(spark, sf):
    return _t(spark, sf, "orders").withColumns({"k": F.col("o_orderkey"), "day": F.date_format("o_orderdate", DAY)})


def made(df, cells: dict[str, str]):
    """``df`` by expressions that both engines know."""
    return df.selectExpr(*[f"{e} AS {n}" for n, e in cells.items()])


def cells_sql(cells: dict[str, str], source: str = "base") -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in cells.items())} FROM {source}"


_CODES = {
    "k": "k",
    "typed": "CASE k % 4 WHEN 0 THEN 'ｏｒｄ－' || k WHEN 1 THEN ' ord_00' || k WHEN 2 THEN 'ord--' || k ELSE 'ORD-' || k END",
    "prose": "CASE k % 4 WHEN 0 THEN 'see ord - 0' || k || 'b now' WHEN 1 THEN 'xord-' || k || '-2' WHEN 2 THEN 'none here' ELSE 'ord ' || k || '.' END",
    "grp": "CASE k % 3 WHEN 0 THEN ' ab' || k || ' ' WHEN 1 THEN 'a b' ELSE '1a' END",
    "display": "CASE k % 3 WHEN 0 THEN 'ORD-' || k WHEN 1 THEN 'ord-' || k ELSE 'ORD-0' || k END",
    "declared": "CASE k % 3 WHEN 0 THEN k WHEN 1 THEN -1 END",
    "suffixed": "CASE k % 2 WHEN 0 THEN 'ORD-' || k || 'A' ELSE 'plain' END",
}


@query(f"""WITH {BASE} SELECT k, CASE WHEN k % 4 <> 2 THEN 'ORD-' || k END AS typed, CASE k % 4 WHEN 0 THEN 'ORD-' || k || 'B' WHEN 3 THEN 'ORD-' || k END AS extracted,
CASE k % 3 WHEN 0 THEN 'AB' || k END AS grp, CASE k % 3 WHEN 0 THEN 'ORD-' || k END AS display,
CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN k ELSE 9223372036854775807 END AS number FROM base""")
def code_forms(spark, sf):
    rows = made(base(spark, sf), _CODES)
    c = F.col
    return rows.select("k", keys.normalize_code_query(c("typed")).alias("typed"), keys.extract_code(c("prose")).alias("extracted"), keys.normalize_prefix(c("grp")).alias("grp"), keys.canonical_code(c("display")).alias("display"), keys.record_number(c("declared"), c("suffixed")).alias("number"))


_NAMES = {
    "id": "p_partkey",
    "wide": "'  Ａ' || p_name || '   Ｂ '",
    "odd": "CASE p_partkey % 4 WHEN 0 THEN '涓' || p_name || '涓' WHEN 1 THEN '涓' || p_name WHEN 2 THEN p_name || '�' ELSE p_name END",
    "header": "'﻿ ' || p_name || ' '",
    "field": "' ' || p_name || ' :： '",
    "p_name": "p_name",
    "p_brand": "p_brand",
    "p_type": "p_type",
}


@query("""SELECT p_partkey AS id, 'a' || lower(p_name) || ' b' AS normal, p_partkey % 4 IN (0, 2) AS damaged, upper(p_name) AS header, replace(p_name, ' ', '') AS label,
p_brand || '|' || p_name AS names, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ', ' || p_brand ELSE p_name || ', ' || p_brand || ' +2' END AS summary FROM part""")
def text_forms(spark, sf):
    rows = made(_t(spark, sf, "part"), _NAMES)
    c = F.col
    some = F.slice(F.array("p_name", "p_brand", "p_type", F.col("id").cast("string")), 1, F.when(c("id") % 3 == 0, 1).when(c("id") % 3 == 1, 2).otherwise(4))
    names = text.distinct_names(F.array(F.concat(F.lit(" "), "p_brand"), "p_brand", F.lit(""), "p_name"))
    return rows.select("id", text.normalize_text(c("wide")).alias("normal"), text.damaged(c("odd")).alias("damaged"), text.header_name(c("header")).alias("header"), text.label(c("field")).alias("label"), F.array_join(names, "|").alias("names"), text.summary(some, 2).alias("summary"))


_VALUES = {
    "k": "k",
    "whole": "CASE k % 6 WHEN 0 THEN '' || (k + 1) WHEN 1 THEN '-3' WHEN 2 THEN '0' WHEN 3 THEN '12.7' WHEN 4 THEN 'x' END",
    "instant": "CASE k % 4 WHEN 0 THEN day || 'T01:02:03Z' WHEN 1 THEN day || 'T01:02:03' WHEN 2 THEN '2024-13-02T03:04:05Z' END",
    "color": "CASE k % 5 WHEN 0 THEN '#ABC' WHEN 1 THEN ' #A1b2C3' WHEN 2 THEN 'rgb(255, 0, ' || (k % 256) || ')' WHEN 3 THEN 'rgb(256,0,0)' ELSE 'red' END",
}


@query(f"""WITH {BASE} SELECT k, CASE WHEN k % 6 = 0 THEN k + 1 END AS positive, CASE k % 6 WHEN 0 THEN k + 1 WHEN 2 THEN 0 END AS nonnegative, k % 4 = 0 AS instant,
CASE k % 5 WHEN 0 THEN '#aabbcc' WHEN 1 THEN '#a1b2c3' WHEN 2 THEN format('#ff00{{:02x}}', k % 256) END AS color FROM base""")
def value_forms(spark, sf):
    rows = made(base(spark, sf), _VALUES)
    return rows.select("k", values.positive_int(F.col("whole")).alias("positive"), values.nonnegative_int(F.col("whole")).alias("nonnegative"), values.valid_instant(F.col("instant")).alias("instant"), urls.normalize_color(F.col("color")).alias("color"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_filter([l_partkey, -1, l_suppkey, l_partkey, 0, NULL], lambda x: x > 0))), ',') AS ids FROM lineitem")
def tag_id_lists(spark, sf):
    ids = values.clean_ids(F.array("l_partkey", F.lit(-1), "l_suppkey", "l_partkey", F.lit(0), F.lit(None)).cast("array<bigint>"))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 3 THEN url END AS target FROM pages")
def unwrapped_urls(spark, sf):
    wrapped = F.concat(F.lit("https://www.google.com/url?z=1&q="), F.url_encode("url"))
    raw = F.when(F.col("page_id") % 4 == 0, wrapped).when(F.col("page_id") % 4 == 1, F.concat(wrapped, F.lit("&q=b"))).when(F.col("page_id") % 4 == 2, F.lit("https://google.com/url?x=1")).otherwise(F.col("url"))
    return _t(spark, sf, "pages").select("page_id", urls.unwrap_redirect(raw).alias("target"))


_PLACES = {
    "k": "k",
    "u": """CASE k % 8 WHEN 0 THEN 'https://drive.google.com/drive/folders/f' || k WHEN 1 THEN 'https://drive.google.com/file/d/x' || k || '/view' WHEN 2 THEN 'https://drive.google.com/open?id=o' || k
WHEN 3 THEN 'https://docs.google.com/spreadsheets/d/s' || k || '/edit?gid=7#gid=7' WHEN 4 THEN 'https://docs.google.com/spreadsheets/d/s' || k || '/edit?gid=7#gid=8'
WHEN 5 THEN 'https://docs.google.com/spreadsheets/d/s' || k || '/edit' WHEN 6 THEN 'http://x.example/' || k ELSE 'https://drive.google.com/open?id=a&id=b' END""",
    "href": "CASE k % 4 WHEN 0 THEN '../search/index.php?tag_id=' || (k + 1) WHEN 1 THEN '/search/index.php?tag_id=0' WHEN 2 THEN '/x.php?tag_id=6' ELSE '/search/index.php?tag_id=1&tag_id=2' END",
}


@query(f"""WITH {BASE} SELECT k, CASE WHEN k % 8 <= 2 THEN 'drive' WHEN k % 8 <= 5 THEN 'sheet' ELSE 'opaque' END AS kind,
CASE k % 8 WHEN 3 THEN 'https://docs.google.com/spreadsheets/d/s' || k || '/export?format=csv&gid=7' WHEN 5 THEN 'https://docs.google.com/spreadsheets/d/s' || k || '/export?format=csv&gid=0' END AS export,
CASE k % 4 WHEN 0 THEN k + 1 END AS tag_id FROM base""")
def url_forms(spark, sf):
    rows = made(base(spark, sf), _PLACES)
    return rows.select("k", urls.destination(F.col("u")).alias("kind"), urls.export_url(F.col("u")).alias("export"), urls.query_id(F.col("href"), "/search/index.php", "tag_id").alias("tag_id"))


_COVERS = {
    "k": "k",
    "code": "'ORD-' || k",
    "product_id": "CASE WHEN k % 3 <> 0 THEN k END",
    "cover": "CASE k % 4 WHEN 0 THEN 'https://h.example/db/ord/' || k || '/pac_s.jpg' WHEN 1 THEN 'http://h.example/db/ord/' || k || '/pac_s.jpg' WHEN 2 THEN 'https://other.example/db/ord/pac_s.jpg' END",
    "n": "CAST(k % 9 AS INT)",
}
_DIR = "'https://h.example/db/ord/' || k || '/sample/'"


@query(f"""WITH {BASE} SELECT k, CASE k % 4 WHEN 0 THEN {_DIR} END AS preview_base, k % 4 = 0 AS is_base, k % 4 = 0 AS eligible,
CASE WHEN k % 4 = 0 THEN array_to_string(list_transform(range(2, least(k % 9, 7) + 1), lambda i: {_DIR} || lpad(i::VARCHAR, 3, '0') || '_l.jpg'), ' ') ELSE '' END AS previews,
CASE k % 2 WHEN 0 THEN 'http://h/ord/p' || k || '.jpg' ELSE 'http://h/review/p.jpg' END AS picked FROM base""")
def cover_forms(spark, sf):
    rows = made(base(spark, sf), _COVERS)
    found = urls.preview_base(F.col("cover"), "h.example", "db")
    own = F.when(F.col("k") % 2 == 0, F.concat(F.lit("http://h/ord/p"), F.col("k").cast("string"), F.lit(".jpg"))).otherwise("http://h/zzz/p.jpg")
    return rows.select(
        "k", found.alias("preview_base"), urls.is_preview_base(found, "h.example", "db").alias("is_base"), urls.eligible_cover(F.col("cover"), "h.example", "db").alias("eligible"),
        F.array_join(urls.preview_urls(found, F.col("n"), 2, 9), " ").alias("previews"), urls.pick_cover(F.array(F.lit("http://h/review/p.jpg"), own), F.col("code")).alias("picked"),
    )


@query(f"WITH {BASE} SELECT 'ORD-' || k AS code, CASE WHEN k % 5 = 0 THEN 'b' WHEN k % 4 = 0 AND k % 3 <> 0 THEN {_DIR} END AS preview_base, CASE WHEN k % 5 = 0 THEN 7 WHEN k % 4 = 0 AND k % 3 <> 0 THEN 18 END AS preview_count FROM base")
def backfilled_previews(spark, sf):
    rows = made(base(spark, sf), {**_COVERS, "preview_base": "CASE WHEN k % 5 = 0 THEN 'b' END", "preview_count": "CASE WHEN k % 5 = 0 THEN 7 END"})
    return refresh.backfill_previews(rows, urls.preview_base(F.col("cover"), "h.example", "db")).select("code", "preview_base", "preview_count")


_RAW = {
    "code": "CASE k % 5 WHEN 3 THEN 'ord ' ELSE 'ord_0' || k END",
    "title": "'' || k",
    "series": "CASE k % 5 WHEN 1 THEN 'XX' ELSE 'ORD' END",
    "number": "CASE k % 5 WHEN 2 THEN '7x' ELSE '' || k END",
    "date": "day",
    "productId": "CASE WHEN k % 2 = 0 THEN '' || (k + 1) ELSE '-1' END",
    "links": """CASE WHEN k % 3 = 0 THEN '{"gofile":" http://g/' || k || ' ","streamtape":" ","uncensored":{"gofile":"","streamtape":"http://u/' || k || '"}}' WHEN k % 3 = 1 THEN '{"gofile":""}' END""",
}


@query(f"""WITH {BASE} SELECT '' || k AS title, CASE k % 5 WHEN 3 THEN 'invalid_code' WHEN 1 THEN 'series_mismatch' WHEN 2 THEN 'number_mismatch' END AS reject_reason,
CASE WHEN k % 5 <> 3 THEN 'ORD-' || k END AS code, day AS release_date, CASE WHEN k % 2 = 0 THEN k + 1 END AS product_id,
CASE WHEN k % 3 = 0 THEN '/gofile=http://g/' || k || ' uncensored/streamtape=http://u/' || k END AS links FROM base""")
def canonical_forms(spark, sf):
    rows = records.canonical_records(made(base(spark, sf), _RAW))
    shown = F.array_join(F.transform("links", lambda x: F.concat(x["scope"], F.lit("/"), x["provider"], F.lit("="), x["url"])), " ")
    return rows.select("title", "reject_reason", "code", "release_date", "product_id", shown.alias("links"))


_QUALITY = {
    "code": "'ORD-' || (k - k % 4)",
    "title": "CASE WHEN k % 4 = 3 THEN '涓涓' ELSE 't' || k END",
    "product_id": "CASE WHEN k % 8 = 1 THEN k + 1 END",
    "release_date": "CASE WHEN k % 8 = 6 THEN '2001-2-3' ELSE day END",
    "cover": "CASE WHEN k % 8 = 4 THEN 'http://c/' || k END",
    "actor": "CASE WHEN k % 4 = 2 THEN ' ' ELSE 'a' END",
}


@query(f"""WITH {BASE}, c AS ({cells_sql(_QUALITY)}), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY product_id IS NOT NULL DESC, strftime(try_strptime(release_date, '%Y-%m-%d'), '%Y-%m-%d') = release_date DESC,
cover IS NOT NULL DESC, trim(actor) <> '' DESC, title NOT LIKE '涓涓' DESC, '{{"actors":["' || actor || '"],"code":"' || code || '",' || coalesce('"cover":"' || cover || '",', '') || coalesce('"product_id":' || product_id || ',', '') || '"release_date":"' || release_date || '","title":"' || title || '"}}' DESC) AS place FROM c)
SELECT code, title, release_date FROM r WHERE place = 1""")
def quality_winners(spark, sf):
    rows = made(base(spark, sf), _QUALITY).withColumn("actors", F.array("actor")).drop("actor")
    return records.select_records(rows).select("code", "title", "release_date")


@query(f"WITH {BASE} SELECT 'ORD-' || k AS code, k AS product_id FROM base WHERE k BETWEEN 10 AND 1200 AND day >= '1997-01-01'")
def filtered_incoming(spark, sf):
    rows = orders(spark, sf).withColumn("product_id", F.col("number"))
    return refresh.filter_incoming(rows, 10, 1200, "1997-01-01").select("code", "product_id")


@query(f"WITH {BASE} SELECT CASE k % 11 WHEN 3 THEN 'ord ' || k || 'x' ELSE 'no code' END AS code, k AS product_id FROM base WHERE k BETWEEN 10 AND 1200 AND day >= '1997-01-01' AND k % 11 IN (3, 5)")
def unpublishable_incoming(spark, sf):
    rows = made(base(spark, sf), {"code": "CASE k % 11 WHEN 3 THEN 'ord ' || k || 'x' WHEN 5 THEN 'no code' ELSE 'ORD-' || k END", "product_id": "k", "release_date": "day"})
    return refresh.unpublishable(rows, 10, 1200, "1997-01-01").select("code", "product_id")


@query(f"WITH {BASE} SELECT 'ORD-' || k AS code, o_orderpriority AS title FROM base")
def record_metadata(spark, sf):
    return values.metadata_view(orders(spark, sf).select("code", "title", F.lit("{}").alias("links")))
