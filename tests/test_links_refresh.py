import pytest
from pyspark.sql import functions as F

from recordkeep.operators import links as L
from recordkeep.operators import refresh as R

LEAF = "code string, scope string, provider string, url string"
REC = "code string, product_id long, release_date string, title string"


def leaves(spark, *rows):
    return spark.createDataFrame([(c, "", p, u) for c, p, u in rows], LEAF)


def as_dict(df):
    return {(r.code, r.provider): r.url for r in df.collect()}


def test_policies_differ(spark):
    old, new = leaves(spark, ("A-1", "x", "1"), ("A-1", "y", "1"), ("A-2", "x", "1")), leaves(spark, ("A-1", "x", "2"), ("A-3", "x", "2"))
    assert as_dict(L.overlay(old, new)) == {("A-1", "x"): "2", ("A-1", "y"): "1", ("A-2", "x"): "1", ("A-3", "x"): "2"}
    assert as_dict(L.append_only(old, new))[("A-1", "x")] == "1"
    assert [tuple(r) for r in L.append_conflicts(old, new).collect()] == [("A-1", "", "x", "1", "2")]
    assert as_dict(L.keep_verified(new, old, "x")) == {("A-1", "x"): "1", ("A-2", "x"): "1", ("A-3", "x"): "2"}


def test_smallest_last_and_diagnostics(spark):
    raw = leaves(spark, ("a_1", "x", " b "), ("A-01", "x", "a"), ("A-1", "y", " "), ("bad", "x", "a"))
    got = L.smallest_wins(raw).collect()
    assert [(r.code, r.url, r.seen) for r in got] == [("A-1", "a", ["a", "b"])]
    cells = spark.createDataFrame([(1, "A-1", "", "x", "http://a/1"), (2, "A-1", "", "x", "oops"), (3, "A-1", "", "x", "http://a/2"), (3, "A-2", "", "x", "")], "row_no int, " + LEAF)
    assert as_dict(L.last_valid(cells)) == {("A-1", "x"): "http://a/2"}
    assert sorted((r.kind, r.code) for r in L.sheet_diagnostics(cells).collect()) == [("conflict", "A-1"), ("duplicate_code", "A-1"), ("invalid_url", "A-1")]


def test_group_links(spark):
    raw = spark.createDataFrame([(" ab", "subtitle", " b "), ("AB", "subtitle", "a"), ("AB", "gofile", " "), ("9x", "subtitle", "a")], "prefix string, provider string, url string")
    got = L.smallest_group_wins(raw)
    assert [(r.prefix, r.url, r.seen) for r in got.collect()] == [("AB", "a", ["a", "b"])]
    groups = spark.createDataFrame([("AB", 1), ("CD", 2)], "prefix string, n int")
    assert {r.prefix: r.links for r in L.attach_group_links(groups, got).collect()} == {"AB": {"subtitle": "a"}, "CD": None}


def test_attach_and_badges(spark):
    rec = spark.createDataFrame([("A-1", "stale"), ("A-2", "stale")], "code string, links string")
    links = spark.createDataFrame([("A-1", "", "gofile", "http://g/1"), ("A-1", "uncensored", "gofile", "http://g/2"), ("A-9", "", "gofile", "http://g/3"), ("A-1", "", "streamtape", "javascript:x")], LEAF)
    got = {r.code: r.links for r in L.attach_links(rec, links).collect()}
    assert got["A-2"] is None and set(got["A-1"]) == {"", "uncensored"}
    shown = {(r.code, r.scope): [b.provider for b in r.badges] for r in L.badges(links).collect()}
    assert shown[("A-1", "")] == ["gofile"] and L.linked_count(links).first().linked == 2


PREV = [("A-1", 1, "2024-01-01", "p"), ("A-2", None, "2024-01-02", "p"), ("A-3", 3, "2024-01-03", "p"), ("A-4", 40, None, "p")]
INC = [("A-1", 1, "2024-01-01", "i"), ("A-5", 5, "2024-01-05", "i"), ("A-6", 60, "2024-01-06", "i")]


@pytest.mark.parametrize(
    ("how", "want"),
    [
        (R.Refresh(R.LINKS_ONLY, True), {"A-1": "p", "A-2": "p", "A-3": "p", "A-4": "p"}),
        (R.Refresh(R.INCREMENTAL, True), {"A-1": "i", "A-2": "p", "A-3": "p", "A-4": "p", "A-5": "i", "A-6": "i"}),
        (R.Refresh(R.AUDIT, False), {"A-1": "i", "A-2": "p", "A-3": "p", "A-4": "p", "A-5": "i", "A-6": "i"}),
        (R.Refresh(R.AUDIT, True), {"A-1": "i", "A-2": "p", "A-5": "i", "A-6": "i"}),
        (R.Refresh(R.AUDIT, True, number_from=1, number_to=9), {"A-1": "i", "A-2": "p", "A-4": "p", "A-5": "i"}),
        (R.Refresh("other", True), {"A-1": "i", "A-5": "i", "A-6": "i"}),
    ],
)
def test_retention(spark, how, want):
    got = R.retain(spark.createDataFrame(INC, REC), spark.createDataFrame(PREV, REC), how)
    assert {r.code: r.title for r in got.collect()} == want
    assert R.retain(spark.createDataFrame(INC, REC), None, how).count() == 3


def test_bounds_flag():
    assert not R.Refresh().is_bounded and R.Refresh(date_to="2024").is_bounded and R.Refresh(bounded=True).is_bounded and not R.Refresh(bounded=False, number_from=1).is_bounded


def test_diff_and_counts(spark):
    old, new = spark.createDataFrame(PREV, REC), spark.createDataFrame([*INC, PREV[2]], REC)
    got = {r.code: r.change for r in R.diff(old, new).collect()}
    assert got == {"A-1": "updated", "A-2": "deleted", "A-3": "retained", "A-4": "deleted", "A-5": "added", "A-6": "added"}
    assert tuple(R.diff_counts(R.diff(old, new)).first()) == (2, 2, 1, 1)
    a = spark.createDataFrame([("A-1", "l"), ("A-2", "l"), ("A-3", None), ("A-4", "l")], "code string, links string")
    b = spark.createDataFrame([("A-1", "l"), ("A-2", "m"), ("A-3", "l"), ("A-5", "l")], "code string, links string")
    assert {r.code: r.link_change for r in R.diff(a, b, "links").collect()} == {"A-1": None, "A-2": "link_updated", "A-3": "link_added", "A-4": "link_removed", "A-5": "link_added"}


def test_counters_keys_and_candidates(spark):
    a = spark.createDataFrame([("A-1", "l"), ("A-2", "l"), ("A-3", None)], "code string, links string")
    b = spark.createDataFrame([("A-1", "m"), ("A-3", "l"), ("A-5", "l")], "code string, links string")
    counts = R.refresh_counts(R.diff(a, b, "links"), b.where("links is not null"), a.limit(1), 4).first()
    assert counts.asDict() == {"added": 1, "updated": 0, "retained": 2, "deleted": 1, "link_added": 2, "link_updated": 1, "link_removed": 1, "linked": 3, "link_conflicts": 5}
    maps = spark.createDataFrame([(1, {"x": 1}), (2, {"x": 1, "y": 2, "z": 3}), (3, {"x": 1, "y": 2}), (4, None)], "k int, m map<string,int>")
    assert {r.k: (r.missing, r.extra) for r in R.key_errors(maps, "m", ("x", "y")).collect()} == {1: (["y"], []), 2: ([], ["z"]), 4: (None, None)}
    one, two = a.select("code"), b.select("code")
    assert [R.candidates(one, two, R.Refresh(m), p).count() for m, p in ((R.LINKS_ONLY, True), (R.INCREMENTAL, False), (R.INCREMENTAL, True), (R.AUDIT, False))] == [3, 6, 3, 3]
    assert {tuple(r) for r in R.known_keys(one, spark.createDataFrame([("b_01",), ("bad",)], "code string")).collect()} == {("A-1", "A"), ("A-2", "A"), ("A-3", "A"), ("B-1", "B")}
    bad = spark.createDataFrame([("oops", 1, "2024-01-01")], "code string, product_id long, release_date string")
    with pytest.raises(Exception, match="not a code: oops"):
        R.filter_incoming(bad, 1, 3).collect()
    assert R.unpublishable(bad, 1, 3).count() == 1 and R.filter_incoming(bad, 2, 3).count() == 0


def test_precision_previews_and_splits(spark):
    kind = "code string, product_id long, preview_base string, preview_count int"
    old = spark.createDataFrame([("A-1", 1, "b", 30), ("A-2", 1, "c", 30)], kind)
    new = spark.createDataFrame([("A-1", 1, "b", 18), ("A-2", 1, "b", 18), ("A-3", 2, None, None), ("A-4", None, None, None)], kind)
    assert {r.code: r.preview_count for r in R.preserve_precision(new, old).collect()} == {"A-1": 30, "A-2": 18, "A-3": None, "A-4": None}
    assert {r.code: (r.preview_base, r.preview_count) for r in R.backfill_previews(new, F.lit("d")).collect()} == {"A-1": ("b", 18), "A-2": ("b", 18), "A-3": ("d", 18), "A-4": (None, None)}
    assert {r.code: r.is_known for r in R.known_split(new, old, "code").collect()} == {"A-1": True, "A-2": True, "A-3": False, "A-4": False}
    cards = spark.createDataFrame([(1, "A-1", "t"), (2, None, None), (3, None, None)], "product_id long, code string, title string")
    details = spark.createDataFrame([(2, "A-2", "d")], "product_id long, code string, title string")
    assert {r.product_id: (r.code, r.resolved) for r in R.resolve_unparsed(cards, details).collect()} == {1: ("A-1", True), 2: ("A-2", True), 3: (None, False)}
    assert [tuple(r) for r in R.remapped_ids(old, new.withColumn("code", F.lit("A-9")).where("product_id = 1").limit(1)).collect()] == [(1, "A-9", "A-1"), (1, "A-9", "A-2")]
    assert {(r.code, r.side) for r in R.unequal_sets(old.select("code"), new.select("code")).collect()} == {("A-3", "right"), ("A-4", "right")}
    assert R.lost_rows(old, old).count() == 0 and R.filter_incoming(spark.createDataFrame(PREV, REC), 1, 3).count() == 2


def test_without_previous_records_all_is_new(spark):
    new = spark.createDataFrame([("A-1", 1, "2024-01-01"), ("A-2", None, None)], "code string, product_id long, release_date string")
    for how in (R.Refresh(), R.Refresh(R.AUDIT, True), R.Refresh(R.AUDIT, True, number_from=5), R.Refresh(R.LINKS_ONLY), R.Refresh(R.LINKS_ONLY, True)):
        assert R.retain(new, new.limit(0), how).count() == 2 == R.retain(new, None, how).count()
