import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from recordkeep.operators import browse as B
from recordkeep.operators import gates as G
from recordkeep.operators import records as R
from recordkeep.operators import search_index
from recordkeep.operators import spread as S
from recordkeep.operators.search_index import SearchIndex
from recordkeep.plans import lineage


def test_neighbours_equal_lag(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([("hot" if rng.random() < 0.7 else f"g{rng.randrange(9)}", k, rng.randrange(50) if rng.random() < 0.9 else None) for k in rng.sample(range(100_000), 4000)], "g string, place long, v long")
    spread = S.neighbours(rows.repartition(9), ["g"], ["place"], F.struct("v"))
    plain = rows.withColumn("before", F.lag(F.struct("v")).over(Window.partitionBy("g").orderBy("place")))
    key = lambda df: sorted((r.g, r.place, r.v, r.before and r.before.v, r.before is None) for r in df.collect())
    assert key(spread) == [(g, p, v, b, n) for g, p, v, b, n in key(plain)]
    whole = S.neighbours(rows.repartition(5), [], [F.col("place")], F.struct("place"))
    order = sorted(r.place for r in rows.collect())
    assert {r.place: r.before and r.before.place for r in whole.collect()} == dict(zip(order, [None, *order]))


def test_a_hot_group_lies_in_many_tasks(spark):
    rows = spark.range(200_000).select(F.lit("one").alias("g"), "id", (F.col("id") % 1000 != 7).cast("long").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cuts = []
        own, S.cut = S.cut, lambda df, name: cuts.append(own(df, name)) or cuts[-1]
        found = S.unsorted(rows, ["g"], "id", ["v"])
        assert found.count() == 200
        sizes = [r["count"] for r in cuts[0].groupBy(F.shiftright("_id", 33).alias("p")).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
    finally:
        S.cut = own
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def numbered(spark, *rows):
    return spark.createDataFrame([(p, n, c) for p, n, c in rows], "prefix string, number long, code string")


def brute(rows, least):
    """The slot view in plain loops."""
    out, groups = [], {}
    for p, n, c in rows:
        groups.setdefault(p, []).append((n, c))
    for p, own in groups.items():
        first = {}
        for n, c in sorted((x for x in own if x[0] is not None and x[0] < 2**63 - 1)):
            first.setdefault(n, c)
        if 0 in first:
            out.append((p, 0, first[0], False))
        for n in range(1, max([least, *first]) + 1):
            out.append((p, n, first.get(n), n not in first))
    return sorted(out, key=str)


def test_slots_against_plain_loops(spark):
    rng = random.Random(3)
    rows = [("A", 0, "A-0B"), ("A", 0, "A-0"), ("B", None, "B"), ("C", 2**63 - 1, "C"), ("D", 5, "D-5B"), ("D", 5, "D-5"), ("D", 9, "D-9")]
    rows += [(f"R{k}", rng.randrange(0, 30), f"R{k}-{j}") for k in range(8) for j in range(rng.randrange(1, 30))]
    for least in (1, 4, 12):
        got = sorted(((r.prefix, r.number, r.code, r.gap) for r in S.slots(numbered(spark, *rows), least=least).collect()), key=str)
        assert got == brute(rows, least)


def test_pages_of_slots_do_not_spell_out_gaps(spark):
    far = 10**12
    c = B.Catalog(numbered(spark, ("AB", 0, "AB-0"), ("AB", 3, "AB-3"), ("AB", far, f"AB-{far}"), ("CD", 7, "CD-7")), None, None, None)
    rows, place = c.group_page("ab", 0, 5, with_gaps=True)
    assert [(r.number, r.code, r.gap) for r in rows.collect()] == [(0, "AB-0", False), (1, None, True), (2, None, True), (3, "AB-3", False), (4, None, True)]
    assert place["total"] == far + 1 and place["next"] == 5
    rows, place = c.group_page("ab", far - 2, 100, with_gaps=True)
    assert [(r.number, r.gap) for r in rows.collect()] == [(far - 2, True), (far - 1, True), (far, False)] and place["next"] is None
    rows, place = c.group_page("cd", with_gaps=True)
    assert [r.number for r in rows.collect()] == list(range(1, 100)) and place["total"] == 99
    assert c.group_page("none", with_gaps=True)[0].count() == 0 and c.group_page("cd", 5, with_gaps=True)[1]["start"] == 5


def test_pages_equal_the_offset_form(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(k, rng.randrange(20), f"t{k}") for k in range(700)], "k long, v long, t string").repartition(5)
    order = [F.desc("v"), F.asc("k")]
    pages = S.Pages.write(rows, order, chunk=64)
    assert pages.total == 700
    for start, limit in ((0, None), (0, 30), (60, 10), (63, 2), (64, 64), (640, 100), (699, 5), (700, 5), (9999, 5), (-3, 7)):
        got, place = pages.page(start, limit)
        want, expected = R.page(rows, order, start, limit)
        assert place == expected and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    plan = pages.page(130, 20)[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan and "PushedFilters: [IsNotNull(place)" in plan
    everything = [tuple(r) for r in rows.orderBy(*order).collect()]
    for at in (0, 63, 64, 200, 698, 699):
        k, v, _ = everything[at]
        beyond = (F.col("v") < v) | ((F.col("v") == v) & (F.col("k") > k))
        assert [tuple(r) for r in pages.after(beyond, 70).collect()] == everything[at + 1 : at + 71]
    tied = S.Pages.write(rows.withColumn("v", F.lit(1)), [F.asc("v")], chunk=100)
    assert sorted(r.k for s in range(0, 700, 100) for r in tied.page(s, 100)[0].collect()) == list(range(700))
    empty = S.Pages.write(rows.limit(0), order)
    assert empty.total == 0 and empty.page()[0].count() == 0


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7)))
    rows = [(f"G{k % 7}-{k}", f"G{k % 7}", k, f"{word()} {word()} Ｂｏｌｔ" if k % 50 == 0 else f"{word()} {word()}", [word()], f"2024-01-{k % 28 + 1:02}", [k % 3 + 1]) for k in range(600)]
    rows += [("G1-1", "G2", 9, "second row of a code, rare zzq", [], "2024-02-01", [])]
    rec = spark.createDataFrame(rows, "code string, prefix string, number long, title string, actors array<string>, release_date string, tag_ids array<long>")
    tags = spark.createDataFrame([(1, "genre", "源", "Source"), (2, "genre", "x", "xyzzy"), (3, "genre", "y", "Other")], "id long, `group` string, name string, translation string")
    c = B.Catalog(rec, R.build_groups(rec), tags, None)
    return c, SearchIndex.write(c, str(tmp_path_factory.mktemp("index") / "i"))


def test_index_gives_what_the_scan_gives(library):
    c, index = library
    for query in ("bolt", "ＢＯＬＴ", "g3_0010", "zzq", "rare zzq", "abc", "ab", "b", "", "  ", "source", "xyzzy", "nowhere at all", "cde d", "g1", "second row", "源", "'%_\\"):
        assert [tuple(r) for r in index.search(query).select(*c.records.columns).collect()] == [tuple(r) for r in c.search(query).select(*c.records.columns).collect()], query
    assert index.plan("ab") is None and index.plan("qqqq") == [] and index.plan("rare zzq") and index.plan("source") is None  # a third of all records


def test_index_reads_few_buckets(library):
    _, index = library
    plan = index.matches("rare zzq")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [cast(bucket" in plan


def test_groups_without_a_date_hide_nothing(spark):
    rows = lambda *xs: spark.createDataFrame(list(xs), "place long, prefix string, latest_date string")
    assert [r.key for r in G.order(rows((1, "A", "2020-01-01"), (2, "B", None), (3, "C", "2021-01-01")), None).collect()] == ["C"]
    assert G.order(rows((1, "A", "2021-01-01"), (2, "B", None), (9, "C", "2021-01-01")), None).count() == 0
    tags = spark.createDataFrame([(1, 5), (2, 7), (3, 7), (4, 2), (5, 9)], "place long, id long")
    assert sorted(r.key for r in G.order(None, None, tags).collect()) == ["2", "7"]


def test_postings_are_written_once_by_blocks(spark, library, tmp_path, monkeypatch):
    """no copy of the postings is cut or moved; a search finds the same over many blocks."""
    catalog, _ = library
    monkeypatch.setattr(search_index, "BLOCK", 100)
    before = sum(map(len, lineage._written.values()))
    index = SearchIndex.write(catalog, str(tmp_path / "i"))
    assert sum(map(len, lineage._written.values())) == before
    assert len(spark.read.parquet(str(tmp_path / "i" / "postings")).inputFiles()) == 7
    for query in ("zzq", "second row", "abc"):
        assert [r.code for r in index.search(query).collect()] == [r.code for r in catalog.search(query).collect()]
