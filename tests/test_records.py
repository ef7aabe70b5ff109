import pytest
from pyspark.sql import functions as F

from recordkeep.operators import records as R
from recordkeep.operators.scans import duplicate_cards, first_seen_page, incremental_cutoff, page_novelty, page_reconciliation, scan_authoritative, scan_stop, scan_summary, tail_cutoff

RAW = "code string, title string, actors array<string>, releaseDate string, cover string, series string, number string, productId string, tagIds array<bigint>"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_canonical_and_rejects(spark):
    got = R.canonical_records(raw(spark, [
        ("ab_007", "t", ["x"], "2024-01-02", None, "AB", "7", "12", [3, 1, 3, -1]),
        ("nope", "t", None, None, None, None, None, None, None),
        ("ab-1", "t", None, None, None, "XX", None, None, None),
        ("ab-1", "t", None, None, None, None, "2", None, None),
        ("ab-1", "t", None, None, None, None, "x", "-4", None),
    ])).collect()
    assert [r.reject_reason for r in got] == [None, "invalid_code", "series_mismatch", "number_mismatch", "number_mismatch"]
    assert got[0].links is None
    linked = spark.createDataFrame([("ab-1", '{"gofile":" http://g ","x":"","uncensored":{"gofile":"http://u","y":" "}}'), ("ab-2", '{"gofile":""}'), ("ab-3", "no json")], "code string, links string")
    assert [None if r.links is None else [tuple(x) for x in r.links] for r in R.canonical_records(linked).collect()] == [[("", "gofile", "http://g"), ("uncensored", "gofile", "http://u")], None, None]
    assert (got[0].code, got[0].prefix, got[0].number, got[0].product_id, got[0].tag_ids) == ("AB-7", "AB", 7, 12, [1, 3]) and got[4].product_id is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_winner_does_not_depend_on_order(spark, seed):
    rows = [
        ("ab-1", "plain", ["x"], "2024-01-01", "http://h/c.jpg", None, None, None, None),
        ("ab-1", "with id", [], "bad", None, None, None, "5", None),
        ("ab-1", "with id and date", [], "2024-01-01", None, None, None, "5", None),
        ("ab-2", "b", ["x"], None, None, None, None, None, None),
        ("ab-2", "a", ["x"], None, None, None, None, None, None),
    ]
    good = R.canonical_records(raw(spark, rows)).drop("reject_reason").repartition(3, F.rand(seed))
    assert sorted((r.code, r.title) for r in R.select_records(good).collect()) == [("AB-1", "with id and date"), ("AB-2", "b")]
    lost = R.discarded(good).collect()
    assert len(lost) == 3 and {r.kind for r in lost} == {"discarded_duplicate"}


def records(spark):
    rows = [("A-2", "A", 2, "2024-02-01"), ("A-1", "A", 1, None), ("B-3", "B", 3, "2024-03-01"), ("C-0", "C", 0, "2024-03-01"), ("C-2", "C", 2, "2024-01-01")]
    return spark.createDataFrame(rows, "code string, prefix string, number long, release_date string")


def test_groups_and_order(spark):
    groups = R.build_groups(records(spark))
    assert [tuple(r) for r in R.in_group_order(groups).collect()] == [("B", 1, "2024-03-01", "2024-03-01"), ("C", 2, "2024-01-01", "2024-03-01"), ("A", 2, "", "2024-02-01")]
    assert [r.prefix for r in R.recent_groups(groups, 2).collect()] == ["B", "C"] and R.recent_groups(groups, -1).count() == 0 and R.recent_groups(groups, None).count() == 3
    nested = {r.prefix: r for r in R.nested_groups(records(spark)).collect()}
    assert [x.code for x in nested["A"].records] == ["A-1", "A-2"]
    links = spark.createDataFrame([("A-1", "u"), ("A-1", "v"), ("X-1", "u")], "code string, url string")
    assert tuple(R.totals(records(spark), links).first()) == (3, 5, 1)
    assert [r.code for r in R.featured(records(spark), groups, F.col("number") >= 0).collect()] == ["B-3"]
    assert [r.code for r in R.unsorted(records(spark).withColumn("at", F.col("number")), ["prefix"], "at", ["release_date"]).collect()] == ["C-2"]


def test_pages_and_slots(spark):
    many = spark.range(260)
    rows, place = R.page(many, ["id"], 250)
    assert [r.id for r in rows.collect()] == list(range(250, 260)) and place == {"start": 250, "end": 260, "size": 100, "total": 260, "previous": 150, "next": None}
    rows, place = R.page(many, ["id"], 10_000)
    assert place["start"] == place["end"] == 260 and rows.count() == 0
    assert R.page(many, ["id"], 0, 500)[1]["size"] == 100 and R.page(many, ["id"], 0, 7)[1]["next"] == 7 and R.page(many, ["id"], 0, 0)[1]["size"] == 100
    rows, place = R.page(spark.range(250), ["id"], 50)
    assert rows.count() == 200 and place["next"] is None
    rows, place = R.page(spark.range(250), ["id"], 50, 20)
    assert [r.id for r in rows.collect()] == list(range(50, 70)) and (place["next"], place["previous"]) == (70, 30)
    assert R.page(spark.range(250), ["id"], 0, 0)[0].count() == 0
    slots = R.slots(records(spark), least=3).orderBy("prefix", "number").collect()
    assert [(r.prefix, r.number, r.code) for r in slots if r.prefix == "C"] == [("C", 0, "C-0"), ("C", 1, None), ("C", 2, "C-2"), ("C", 3, None)]


def test_contiguous_prefix(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4), ("b", 2), ("c", 0), ("c", 1)], "k string, i int")
    assert {r.k: r.n for r in R.contiguous_prefix(rows, "k", "i").collect()} == {"a": 2, "b": 0, "c": 1}


def test_scans(spark):
    cards = spark.createDataFrame([(1, 10, True), (1, 11, True), (2, 10, True), (2, 12, False), (3, 11, True), (4, 10, True), (4, 10, True), (5, None, False)], "page int, product_id long, parsed boolean")
    known = spark.createDataFrame([(12,)], "product_id long")
    novelty = page_novelty(cards, known)
    assert {r.page: r.new for r in novelty.collect()} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 0}
    assert incremental_cutoff(novelty).first().cutoff == 3 and incremental_cutoff(novelty.where("page < 3")).first().cutoff is None
    assert {r.product_id: r.first_page for r in first_seen_page(cards).collect()}[10] == 1
    probes = lambda s: spark.createDataFrame([(i, {"m": "miss", "h": "hit", "e": "error"}[c]) for i, c in enumerate(s)], "probe int, outcome string")
    assert [tail_cutoff(probes(s)).first().cutoff for s in ("mmm", "mmhmmm", "mmemm", "hmmmm", "m" * 2)] == [2, 5, None, 3, None]
    assert tail_cutoff(probes("h" * 25 + "mmm")).first().cutoff is None and tail_cutoff(probes("h" * 25 + "mmm"), most=30).first().cutoff == 27
    with pytest.raises(ValueError):
        tail_cutoff(probes("m"), most=None)
    many = probes("mmm").withColumn("u", F.lit(1)).unionByName(probes("mhm").withColumn("u", F.lit(2)))
    assert {r.u: r.cutoff for r in tail_cutoff(many, by="u").collect()} == {1: 2, 2: None}
    facts = {r.page: r for r in page_reconciliation(cards).collect()}
    assert facts[1].complete and not facts[2].complete and facts[4].duplicates == 1 and facts[5].unidentifiable == 1
    assert {(r.page, r.product_id) for r in duplicate_cards(cards).collect()} == {(2, 10), (3, 11), (4, 10)}
    pages = page_reconciliation(cards).join(novelty, "page")
    assert scan_summary(pages).first().asDict() == {"pages": 2, "cards": 4, "parsed": 3, "new": 2, "known": 1, "errors": 1, "cursor": 2, "stop_reason": "error"}
    facts = lambda *rows: spark.createDataFrame(rows, "page int, cards int, new int, complete boolean")
    whole = facts((1, 3, 2, True), (2, 3, 0, True), (3, 3, 0, True), (4, 0, 0, True))
    assert [tuple(scan_stop(whole, m).first()) for m in ("incremental", "audit")] == [(3, "all_known"), (4, "empty")]
    assert tuple(scan_stop(whole.where("page < 3")).first()) == (None, "page_limit")
    listed = page_novelty(cards, known, fetched=spark.range(1, 8).selectExpr("cast(id as int) page"))
    assert {r.page for r in listed.collect()} == set(range(1, 8))
    assert not scan_authoritative(pages, True, True).first().authoritative
