import pytest
from pyspark.sql import functions as F

from recordkeep.operators import gates as G
from recordkeep.operators import records as R
from recordkeep.operators import refresh as RF
from recordkeep.operators import tags as T

REC = "code string, prefix string, number long, title string, actors array<string>, release_date string, cover string, product_id long"
GOOD = [("A-1", "A", 1, "t", ["x"], "2024-01-01", "http://h/c.jpg", 1), ("A-2", "A", 2, "t", ["x"], "2024-01-02", None, 2), ("B-1", "B", 1, "t", [], "2024-01-03", None, None)]


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, REC)
    return sorted({(r.gate, r.key) for r in G.violations(df, kw.pop("groups", None) or R.build_groups(df), **kw).collect()})


def test_a_good_snapshot_passes(spark):
    assert found(spark, GOOD) == []
    assert found(spark, GOOD, previous=spark.createDataFrame(GOOD[:2], REC)) == []


def test_each_fault_is_found(spark):
    change = lambda at, **kw: [tuple({**dict(zip(("code", "prefix", "number", "title", "actors", "release_date", "cover", "product_id"), r, strict=True)), **(kw if i == at else {})}.values()) for i, r in enumerate(GOOD)]
    cases = [
        (change(0, number=5), ("G3", "A-1")),
        (change(1, code="A-1", number=1), ("G3", "A-1")),
        (change(1, product_id=1), ("G4", "1")),
        (change(1, product_id=-1), ("G4", "A-2")),
        (change(0, title=" "), ("G6", "A-1")),
        (change(0, title="涓涓"), ("G6", "A-1")),
        (change(0, actors=["", "x"]), ("G6", "A-1")),
        (change(0, release_date="2024-1-1"), ("G7", "A-1")),
        (change(0, release_date="1999-01-01"), ("G7", "A-1")),
        (change(0, cover="ftp://x"), ("G8", "A-1")),
    ]
    for rows, want in cases:
        assert want in found(spark, rows), want
    stated = spark.createDataFrame([("A", 3, "2024-01-01", "2024-01-02"), ("B", 1, "2024-01-03", "2024-01-04")], "prefix string, n long, first_date string, latest_date string")
    assert found(spark, GOOD, groups=stated) == [("G12", "B"), ("G2", "A")]
    assert G.not_empty(spark.createDataFrame([], REC)).count() == 1


def test_gates_against_the_predecessor(spark):
    before, now = spark.createDataFrame(GOOD, REC), spark.createDataFrame(GOOD[1:], REC)
    changes = RF.diff(before, now)
    assert [r.gate for r in G.deletions(changes, RF.Refresh()).collect()] == ["G18"]
    assert [r.gate for r in G.deletions(changes, RF.Refresh(RF.LINKS_ONLY)).collect()] == ["G19"]
    assert [r.gate for r in G.deletions(changes, RF.Refresh(RF.AUDIT, False)).collect()] == ["G20"]
    assert G.deletions(changes, RF.Refresh(RF.AUDIT, True)).count() == 0
    assert [r.key for r in G.deletions(changes, RF.Refresh(RF.AUDIT, True, number_from=2), before).collect()] == ["A-1"]


def test_regression_limits_are_strict(spark):
    make = lambda n: spark.range(n).select(F.concat(F.lit("A-"), F.col("id").cast("string")).alias("code"), F.lit("A").alias("prefix"))
    whole = lambda a, b: {r.prefix: (r.deleted, r.broken) for r in G.regression(make(a), make(b)).collect()}[None]
    of_group = spark.createDataFrame([(f"A-{i}", "A") for i in range(6)] + [(f"B-{i}", "B") for i in range(7)], "code string, prefix string")
    left = {r.prefix: r.broken for r in G.regression(of_group, of_group.where("code not in ('A-0', 'B-0')")).collect()}
    assert left == {"A": True, "B": False, None: True}  # one of six is over 15 %, one of seven is not
    assert whole(100, 85) == (15, False) and whole(100, 84) == (16, True) and whole(1000, 900) == (100, False) and whole(1000, 899) == (101, True)


def test_small_gates(spark):
    head = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", "audit"), (2, "x", "y")], "schema_version int, generated_at string, mode string")
    assert G.header(head).count() == 3
    links = spark.createDataFrame([("A-1", "", "gofile", "http://a"), ("A-1", "uncensored", "subtitle", "http://a"), ("A-2", "", "gofile", "a")], "code string, scope string, provider string, url string")
    assert G.link_shape(links).count() == 2 and G.strict_links(spark.createDataFrame(GOOD, REC), links, 2).count() == 2
    assert G.totals(spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(1, 3)], "a long, b long")).count() == 1
    assert G.hashes(spark.createDataFrame([("a", "0" * 64), ("b", "X"), ("c", None)], "name string, hash string")).count() == 2
    assert {r.key for r in G.paths(spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("..",), ("a\\b",)], "path string")).collect()} == {"/a", "a/../b", "..", "a\\b"}
    assert G.header_errors(["NEW CODE", "GOFILE", "UNCENSORED", "GOFILE"], providers=("GOFILE",)) == [] and G.header_errors(["UNCENSORED", "NEW CODE"]) and G.header_errors([]) and G.header_errors(["NEW CODE", "UNCENSORED", "GOFILE"], providers=("GOFILE",))
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "prefix string")
    assert [r.key for r in G.disjoint({"a": one("A", "B"), "b": one("B", "C")}).collect()] == ["B"]
    assert G.membership(one("A", "Z"), one("A"), "prefix").count() == 1 and G.continuity(one("A", "B"), one("A"), "prefix").count() == 1
    assert G.sources(spark.createDataFrame([("https://docs.google.com/spreadsheets/d/abc/x", "a,b"), ("https://evil/abc", "<html>")], "source_url string, body string"), "docs.google.com", "/spreadsheets/d/abc/x").count() == 2
    assert G.counters(spark.createDataFrame([(1, 2, 3, 6), (1, 2, 3, 7)], "added int, updated int, retained int, records int")).count() == 1
    assert G.group_links(spark.createDataFrame([("A", "subtitle", "https://drive.google.com/file/d/x"), ("B", "gofile", "http://a")], "prefix string, provider string, url string")).count() == 1
    pre = spark.createDataFrame([("A-1", "https://h.example/db/a/pac_s.jpg", "https://h.example/db/a/sample/", 18), ("A-2", None, None, 3), ("A-3", None, None, None), ("A-4", "https://h.example/db/a/pac_s.jpg", "https://h.example/db/b/sample/", 100)], "code string, cover string, preview_base string, preview_count int")
    assert sorted(r.key for r in G.previews(pre, "h.example", "db").collect()) == ["A-2", "A-4", "A-4"]


def defs(spark):
    return spark.createDataFrame([(1, "genre", "a", "A"), (2, "genre", "b", "B"), (3, "character", "c", None)], "id long, group string, name string, translation string")


def test_tags(spark):
    pairs = spark.createDataFrame([("A-1", 1), ("A-1", 1), ("A-2", 1), ("A-2", 3), ("A-2", 9)], "code string, tag_id long")
    assert {r.id: r.n for r in T.tag_counts(pairs, defs(spark)).collect()} == {1: 2, 2: 0, 3: 1}
    assert [r.tag_id for r in T.unknown_tags(pairs, defs(spark)).collect()] == [9]
    many = spark.createDataFrame([(1, "1", "genre", " a  b", "old"), (2, "1", "genre", "a b", "new"), (3, "x", "genre", "q", "z"), (4, "2", "genre", "", "z")], "seq int, id string, group string, name string, translation string")
    assert [tuple(r) for r in T.normalize_definitions(many).collect()] == [(1, "genre", "a b", "new", "machine")]
    review = spark.createDataFrame([("a b", " R ")], "name string, translation string")
    assert [tuple(r) for r in T.normalize_definitions(many, reviewed=review).collect()] == [(1, "genre", "a b", "R", "reviewed")]
    with pytest.raises(Exception, match="conflicting tag definition"):
        T.normalize_definitions(many.unionByName(many.withColumn("name", F.lit("other")))).collect()
    assert [r.translation for r in T.first_definitions(many.where("id = '1'")).collect()] == ["old"]
    odd = spark.createDataFrame([(1, "g", "a"), (1, "g", "b"), (2, "g", "a"), (2, "g", "a")], "id long, group string, name string")
    assert [r.id for r in T.conflicting_definitions(odd).collect()] == [1]
    merged = T.merge_definitions(defs(spark).where("id = 1").withColumn("name", F.lit("new")), defs(spark))
    assert {r.id: r.name for r in merged.collect()} == {1: "new", 2: "b", 3: "c"}
    assert [r.id for r in T.tag_counts(pairs, defs(spark)).orderBy(*T.tag_order(F.col("name"))).collect()] == [1, 3, 2]


RT = "code string, product_id long, title string, tag_ids array<bigint>, tags_status string, tags_updated_at string, tags_source string"


def test_enrichment(spark):
    rec = spark.createDataFrame([("A-1", 1, "t", None, None, None, None), ("A-2", None, "t", None, None, "2020-01-01T00:00:00Z", None), ("A-3", 3, "t", [1], "complete", "2024-01-01T00:00:00Z", "official"), ("A-4", 4, "t", [1], "complete", "2020-01-01T00:00:00Z", "official")], RT)
    assert [(r.code, r.urgency) for r in T.sync_targets(rec, "2024-02-01T00:00:00Z").collect()] == [("A-1", 0), ("A-4", 1)]
    assert T.sync_targets(rec, "2024-02-01T00:00:00Z", full=True).count() == 3 and T.sync_targets(rec, "2024-02-01T00:00:00Z", k=1).count() == 1
    details = spark.createDataFrame([("A-1", "new", [2])], "code string, title string, tag_ids array<bigint>")
    got = {r.code: r for r in T.apply_details(rec, details, "2024-02-01T00:00:00Z").collect()}
    assert (got["A-1"].title, got["A-1"].tag_ids, got["A-1"].tags_status) == ("new", [2], "complete") and got["A-3"].tag_ids == [1]
    lost = {r.code: r for r in T.mark_unavailable(rec, "now").collect()}
    assert (lost["A-2"].tag_ids, lost["A-2"].tags_updated_at, lost["A-2"].tags_source) == ([], "2020-01-01T00:00:00Z", "official-unavailable") and lost["A-1"].tags_status is None
    over = spark.createDataFrame([("A-2", "22"), ("A-1", "9"), ("Z-1", "1"), ("A-3", "x")], "code string, id string")
    assert {r.code: r.product_id for r in T.apply_id_overrides(rec, over).collect()}["A-2"] == 22
    zero = rec.where("code = 'A-1'").withColumn("product_id", F.lit(0).cast("bigint"))
    assert T.apply_id_overrides(zero, over).first().product_id == 9 and T.override_errors(zero, over.where("code = 'A-1'")).count() == 0
    stale = rec.withColumn("tags_updated_at", F.lit("nonsense"))
    assert {r.code: r.urgency for r in T.sync_targets(stale, "2024-02-01T00:00:00Z").collect()} == {"A-1": 0, "A-3": 1, "A-4": 1}
    assert [r.code for r in T.sync_targets(rec, "2024-02-01T00:00:00Z", full=True).collect()] == ["A-1", "A-3", "A-4"]
    assert {r.code: r.tags_updated_at for r in T.mark_unavailable(stale, "now").collect()}["A-2"] == "now"
    moved = spark.createDataFrame([(1, "A-9"), (3, "A-3")], "product_id long, code string")
    assert [tuple(r) for r in T.detail_mismatches(rec, moved).collect()] == [("A-1", "A-9")]
    messy = spark.createDataFrame([("A-1", [3, -1, 2, 3])], "code string, tag_ids array<bigint>")
    assert {r.code: r.tag_ids for r in T.apply_details(rec, messy, "now").collect()}["A-1"] == [2, 3]
    assert sorted((r.kind, r.code) for r in T.override_errors(rec, over).collect()) == [("conflict", "A-1"), ("invalid_id", "A-3"), ("unknown_code", "Z-1")]
    core, pairs = T.split_runtime(rec)
    assert "tag_ids" not in core.columns and {r.code: r.tag_ids for r in T.hydrate(core, pairs).collect()} == {"A-1": [], "A-2": [], "A-3": [1], "A-4": [1]}
    assert T.hydrate_errors(core, pairs, defs(spark)).count() == 0
    bad = spark.createDataFrame([("A-1", [1, 1]), ("A-1", [9]), ("Q-1", [1]), ("A-2", [])], "code string, tag_ids array<bigint>")
    assert {r.kind for r in T.hydrate_errors(core, bad, defs(spark)).collect()} == {"duplicate_code", "repeated_tag", "unknown_tag", "unknown_code", "empty_list"}
    counted = spark.createDataFrame([(1, 2), (1, 2), (0, 0), (9, 1), (2, 5)], "id long, n long")
    assert {(r.kind, r.key) for r in T.hydrate_errors(core.unionByName(core.limit(1)), bad, counted).collect()} >= {("repeated_definition", "1"), ("invalid_definition", "0"), ("count", "2"), ("repeated_code", "A-1")}
    head = lambda v, g: spark.createDataFrame([(v, g)], "schema_version int, generated_at string")
    assert [[r.kind for r in T.generation_errors(head(1, "a"), p).collect()] for p in (head(1, "a"), head(1, "b"), head(2, "a"))] == [[], ["generation"], ["schema_version"]]
    by_group = T.tags_by_group(spark.createDataFrame([("A-1", [3, 9, 1])], "code string, tag_ids array<bigint>"), defs(spark)).collect()
    assert sorted((r.group, [t.name for t in r.tags]) for r in by_group) == [("character", ["c"]), ("genre", ["a"])]
    shown = T.tag_lookup(spark.createDataFrame([("A-1", [3, 9, 1])], "code string, tag_ids array<bigint>"), defs(spark)).first()
    assert [t.name for t in shown.tags] == ["c", "a"]
    assert tuple(T.sync_summary(rec, T.sync_targets(rec, "2024-02-01T00:00:00Z"), defs(spark)).first()) == (4, 2, 2, 3)


def test_names_and_tag_gates(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, name string")
    blank = spark.createDataFrame([("b", "  ")], "name string, translation string")
    assert {r.id: r.source for r in T.resolve_names(d, blank, blank.selectExpr("2L id", "name", "translation"), spark.createDataFrame([], "id long, translation string")).collect()}[2] == "needed"
    reviewed = spark.createDataFrame([("a", "R")], "name string, translation string")
    stored = spark.createDataFrame([(1, "a", "S"), (2, "b", "S"), (3, "changed", "S")], "id long, name string, translation string")
    cached = spark.createDataFrame([(3, "C")], "id long, translation string")
    assert {r.id: (r.translation, r.source) for r in T.resolve_names(d, reviewed, stored, cached).collect()} == {1: ("R", "reviewed"), 2: ("S", "stored"), 3: ("C", "cached"), 4: (None, "needed")}
    rec = spark.createDataFrame([("A-1", 1, "t", [2, 1], "complete", "2024-01-01T00:00:00Z", "official"), ("A-2", 1, "t", [9], None, None, None)], RT)
    stated = spark.createDataFrame([(1, 1), (2, 7)], "id long, n long")
    found = sorted((r.key, r.message) for r in G.tag_gates(rec, defs(spark), stated, required=True).collect())
    assert found == [
        ("2", "count differs"), ("3", "both names are needed"), ("3", "count differs"), ("3", "count must be stated and not negative"), ("A-1", "tag ids must be unique and sorted"),
        ("A-2", "provenance must be official"), ("A-2", "status must be complete"), ("A-2", "time must be a UTC time ending in Z"), ("A-2", "unknown tag 9"),
    ]
    odd = spark.createDataFrame([(1, "genre", "a", "A"), (1, "genre", "a", "A"), (2, "nonsense", "b", "B"), (0, "genre", "z", "Z"), (None, "genre", "z", "Z"), (4, None, "c", " ")], "id long, group string, name string, translation string")
    assert sorted((r.key or "-", r.message) for r in G.tag_gates(rec.limit(0), odd).collect()) == [("-", "id must be positive"), ("0", "id must be positive"), ("1", "duplicate tag"), ("2", "unknown group"), ("4", "both names are needed"), ("4", "unknown group")]
    anything = spark.createDataFrame([("A-1", 1, "t", None, "complete", "2024-01-01T00:00:00Z", "anything")], RT)
    assert sorted(r.message for r in G.tag_gates(anything, defs(spark).limit(0), required=True).collect()) == ["provenance must be official", "tag ids are missing"] and G.tag_gates(anything, defs(spark).limit(0)).count() == 0
    placed = defs(spark).withColumn("place", F.when(F.col("id") == 1, 9).otherwise(F.col("id")))
    assert [(r.gate, r.key) for r in G.tag_gates(rec.limit(0), placed.where("id < 3")).collect()] == [("G5", "1")]


def test_scan_summaries(spark):
    base = {"mode": "incremental", "stop_reason": "empty", "errors": 0, "parsed": 5, "new": 2, "known": 3, "records": 2, "pages": 4, "cursor": 4, "retries": 0}
    kind = "mode string, stop_reason string, errors long, parsed long, new long, known long, records long, pages long, cursor long, retries long"

    def found(mode="incremental", **cells):
        row = {**base, **cells}
        return sorted(r.message for r in G.scan(spark.createDataFrame([tuple(row.values())], kind), mode).collect())

    assert found() == []
    assert found(pages=0, cursor=0) == ["cursor must be over 0", "did not end where it says"]
    assert found(known=-3, new=8, records=8) == ["a count is missing or negative"] == found(retries=None)
    assert "a count is missing or negative" in found(parsed=None) and "cursor must be over 0" in found(cursor=None)
    assert found(mode="audit") == ["another mode", "another number of records came"]
    row = {"mode": "audit", "records": 5}
    kept = lambda **c: sorted(r.message for r in G.scan(spark.createDataFrame([tuple({**base, **row, **c}.values())], kind), "audit").collect())
    assert kept() == [] and kept(stop_reason="all_known") == ["unknown reason to stop"] and kept(records=2) == ["another number of records came"]
    assert found(errors=1, stop_reason="error", parsed=9, records=77) == [] and found(errors=1) == ["errors and reason to stop differ"] and found(errors=0, stop_reason="error") == ["errors and reason to stop differ"]
    assert found(stop_reason="all_known", pages=1, cursor=1) == ["did not end where it says"] and found(records=3) == ["another number of records came"]


def test_stated_dates_and_counts_are_needed(spark):
    rec = spark.createDataFrame([("A-1", "A", 1, "2024-01-01"), ("B-1", "B", 1, None), ("B-2", "B", 2, "nonsense")], "code string, prefix string, number long, release_date string")
    stated = spark.createDataFrame([("A", 1, None, None), ("B", 2, None, "x")], "prefix string, n long, first_date string, latest_date string")
    assert sorted((r.gate, r.key, r.message) for r in G.groups(stated, rec).collect()) == [("G12", "A", "first date differs"), ("G12", "A", "latest date differs")]
    counts = spark.createDataFrame([(1, 5), (2, 0), (3, 1), (4, 4)], "id long, n long")
    given = spark.createDataFrame([(1, 5), (2, None), (4, 5)], "id long, n long")
    assert sorted(r.id for r in T.stated_counts_differ(counts, given).collect()) == [2, 3, 4]


def test_first_valid_definition_wins(spark):
    rows = [(1, 7, "nonsense", "a", "A", 1), (2, 7, "genre", " ", "A", 1), (3, 7, "genre", " ok ", "B", -4), (4, 7, "genre", "late", "C", 9), (1, 0, "genre", "z", "Z", 1), (1, 8, "genre", "y", None, 1)]
    found = T.first_definitions(spark.createDataFrame(rows, "seq int, id long, group string, name string, translation string, count long"))
    assert [(r.id, r.name, r.translation, r["count"]) for r in found.collect()] == [(7, "ok", "B", 0)]
