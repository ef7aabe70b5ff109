"""Steps of queries that were projected to miss their limits on large tables: what they do once, and that it is the same."""

import gc
import hashlib
import os
from collections import Counter

from pyspark.sql import functions as F

from recordkeep import queries, queries_merge
from recordkeep.functions import keys
from recordkeep.operators import links, spread, tags
from recordkeep.plans import lineage
from recordkeep.sources import documents, pages, sinks, snapshots
from tests.test_documents import GROUPS, LINKS, ROWS, TAGS, same, tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- F5: document_round_trip


def test_lines_are_text_before_they_are_sorted(spark, tmp_path):
    odd = [("é\"-1", 'a\\"', ["\u0001"], None, [1]), ("AB-1", '{"group":', None, "2024-01-01", [])]
    leaves = [("AB-1", "s\"c", "p\\", "http://x/\n"), ("AB-1", "", "a", "ü"), ('é"-1', "u", "p", "")]
    t = tables(spark, odd, leaves, GROUPS, TAGS)
    assert documents.lines(t).columns == ["place", "snapshot", "text"]
    documents.export(t, str(tmp_path / "doc"))
    same(t, documents.read(spark, str(tmp_path / "doc")))


def test_lines_are_parsed_once_for_all_tables(spark, tmp_path):
    t = tables(spark, ROWS, LINKS, GROUPS, TAGS)
    documents.export(t, str(tmp_path / "doc"))
    parsed = documents.read_lines(spark, str(tmp_path / "doc")).cache()
    back = documents.read(spark, str(tmp_path / "doc"), parsed)
    same(t, back)
    assert "Union" not in _plan(back.links)  # a single pass over the records' links


def test_links_of_records_keep_their_defined_cases(spark):
    rows = spark.createDataFrame([("A-1", '{"g":"u","s":{"p":"v","q":null},"n":null,"b":"{oops"}'), ("A-2", None), ("A-3", "no json"), ("A-4", '{"x":" {\\"y\\":\\"z\\"}"}')], "code string, links string")
    got = Counter(map(tuple, snapshots.record_links(rows).collect()))
    assert got == Counter([("A-1", "", "g", "u"), ("A-1", "s", "p", "v"), ("A-1", "s", "q", None), ("A-4", "x", "y", "z")])


def test_codes_in_normal_form_are_taken_as_they_are(spark):
    given = ["AB-1", "AB-0", "AB-007", "AB-1\n", "ab_1", "A1-10 ", "1A-1", "AB-", "AB-1x", "AB-١", "-1", "", None, "AB--1"]
    got = [r.c for r in spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, g string").orderBy("k").select(keys.normalize_code(F.col("g")).alias("c")).collect()]
    assert got == ["AB-1", "AB-0", "AB-7", "AB-1", "AB-1", "A1-10", None, None, None, "AB-1", None, None, None, None]
    assert keys.normalize_code(F.col("g"))._jc.toString().startswith("CASE WHEN rlike(g,")


# --- F7: document_hashes


def test_word_sums_are_of_longs_and_equal_those_of_decimals(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("t"))
    digest = F.sha2("t", 256)
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    before = rows.agg(F.sha2(F.concat_ws(":", F.count("t").cast("string"), *[F.coalesce(F.sum(w), F.lit(0)).cast("string") for w in words]), 256)).first()[0]
    now = rows.agg(sinks.summed_hash(F.col("t")).alias("h"))
    assert now.first().h == before and "decimal(20,0)" not in _plan(now).lower()
    none = rows.where("t is null").agg(sinks.summed_hash(F.col("t")).alias("h")).first().h
    assert none == hashlib.sha256(":".join(["0"] * 9).encode()).hexdigest()


# --- F8: refresh_counters


def test_link_maps_take_one_grouping(spark):
    leaves = [("A-1", "s", "q", "u2"), ("A-1", "", "p", "u1"), ("A-1", "s", "p", None), ("B-2", "s", "p", "u4")]
    found = links.link_maps(spark.createDataFrame(leaves, "code string, scope string, provider string, url string"))
    assert _plan(found).count("Exchange hashpartitioning") == 1
    assert {r.code: list(r.links.items()) for r in found.collect()} == {"A-1": [("", '{"p":"u1"}'), ("s", '{"p":null,"q":"u2"}')], "B-2": [("s", '{"p":"u4"}')]}


# --- F10: hydration_errors


def test_hydration_errors_are_counted_in_one_grouping_of_codes(spark):
    core = spark.createDataFrame([("A",), ("A",), ("B",), (None,), (None,), ("E",)], "code string")
    lists = spark.createDataFrame([("A", [1]), ("B", [1, 1]), ("B", []), ("C", None), ("C", [9]), (None, [2, 2]), ("D", [None])], "code string, tag_ids array<long>")
    defined = spark.createDataFrame([(1, 3), (2, 1), (2, 2), (0, 0), (None, 0)], "id long, n long")
    found = tags.hydrate_errors(core, lists, defined)
    assert _plan(found).count("hashpartitioning(code") == 1
    expected = [("repeated_code", "A"), ("repeated_code", None), ("duplicate_code", "B"), ("duplicate_code", "C"), ("unknown_code", "C"), ("unknown_code", "C"), ("unknown_code", "D"), ("unknown_code", None), ("empty_list", "B"), ("empty_list", "C")]
    expected += [("repeated_tag", "B"), ("repeated_tag", None), ("unknown_tag", "9"), ("unknown_tag", None), ("repeated_definition", "2"), ("invalid_definition", "0"), ("invalid_definition", None), ("count", "2")]
    assert Counter(map(tuple, found.collect())) == Counter(expected)


def test_many_findings_of_one_code_are_all_listed(spark):
    n = 2 * tags.PIECE + 1
    lists = spark.range(n).select(F.lit("X").alias("code"), F.array(F.lit(1).cast("bigint")).alias("tag_ids"))
    found = tags.hydrate_errors(spark.createDataFrame([("A",)], "code string"), lists, spark.createDataFrame([(1,)], "id long"))
    assert Counter(map(tuple, found.collect())) == Counter({("unknown_code", "X"): n, ("duplicate_code", "X"): 1})


# --- F1 of round 4: page_details


def test_details_of_one_row_group_are_read_by_many_tasks(spark, tmp_path):
    spark.range(100).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority", "timestamp'2024-01-02' AS o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    parts = queries_merge._details(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts == 3 * spark.sparkContext.defaultParallelism > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert queries.QUERIES["page_details"](spark, str(tmp_path)).where("code is not null").count() == 83
    assert queries.QUERIES["page_tag_sections"](spark, str(tmp_path)).count() == 100


def test_pages_that_were_read_are_let_go_without_a_collection_of_garbage():
    page = '<div id="a"><p>x<b>y</b></p></div><!-- <i>z</i> -->'
    for html in (page, page + "<script>'</script>"):
        gc.collect()
        gc.disable()
        try:
            assert [e.text() for e in pages._tree(html)][:3] == ["x y", "x y", "y"]
            assert gc.collect() == 0, html
        finally:
            gc.enable()


# --- F2 of round 4: document_round_trip


def test_an_export_leaves_only_its_compressed_lines(spark, tmp_path):
    t = tables(spark, ROWS, LINKS, GROUPS, TAGS)
    kept = lineage.cut(t.links, "kept")
    folder = lineage.session_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    documents.export(t, str(tmp_path / "doc"), part=4, compression="gzip")
    assert set(os.listdir(folder)) == before and kept.count() == len(LINKS)
    names = [n for n in os.listdir(tmp_path / "doc") if n.startswith("part-")]
    assert len(names) > 1 and all(n.endswith(".txt.gz") for n in names)
    same(t, documents.read(spark, str(tmp_path / "doc")))
    documents.export(t, str(tmp_path / "plain"))
    lines = [Counter(r.value for r in spark.read.text(str(tmp_path / d)).collect()) for d in ("doc", "plain")]
    assert lines[0] == lines[1]


def test_rows_with_places_are_not_moved_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spread.placed(spark.range(1000).withColumn("v", F.hash("id")), [F.col("v")])
        assert "Exchange hashpartitioning(_part" not in _plan(found).split("BroadcastExchange")[0]
        assert "SortMergeJoin" not in _plan(found) and [r.place for r in found.orderBy("v").collect()] == list(range(1, 1001))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_links_are_joined_behind_the_groups(spark):
    t = tables(spark, ROWS, LINKS, GROUPS, TAGS)
    made = []
    was, documents.placed = documents.placed, lambda rows, *a, **k: made.append(rows) or was(rows, *a, **k)
    whole, documents.cut = documents.cut, lambda df, *a, **k: made.append(df) or whole(df, *a, **k)
    try:
        documents.lines(t)
    finally:
        documents.placed, documents.cut = was, whole
    plan = made[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Join Inner")  # the outer join is the last
