import json
import random

import pytest
from pyspark.sql import functions as F

from recordkeep.operators import browse as B
from recordkeep.operators import records as R
from recordkeep.sources import pages as P
from recordkeep.sources import sheets as S
from recordkeep.sources import sinks as K
from recordkeep.sources import snapshots as N

SHEET = """﻿new code,StreamTape,Player4me,GoFile,uncensored,StreamTape,Player4me,GoFile
ab_001,http://s/1,http://p/1,,,http://us/1,,
notes,,,,,,,
AB-2,bad url,,http://g/2,,,,http://ug/2
ab-1,http://s/2,,,,,,
"""


def test_link_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(SHEET)
    cells = S.read_link_sheet(spark, str(path))
    got = {(r.code, r.scope, r.provider, r.url) for r in cells.collect()}
    assert ("AB-1", "", "streamtape", "http://s/2") in got and ("AB-1", "uncensored", "streamtape", "http://us/1") in got and ("AB-2", "uncensored", "gofile", "http://ug/2") in got and len(got) == 7
    many = ",".join(f"c{i}" for i in range(90))
    path.write_text(f'{many},new code,StreamTape,Player4me,GoFile,uncensored,StreamTape,Player4me,GoFile\n{many},ab-5,"http://s/\n5",,,,,,http://ug/5\n')
    assert {(r.row_no, r.code, r.url) for r in S.read_link_sheet(spark, str(path)).collect()} == {(1, "AB-5", "http://s/\n5"), (1, "AB-5", "http://ug/5")}
    path.write_text("new code,a\n")
    with pytest.raises(S.SheetError):
        S.read_link_sheet(spark, str(path))


def test_child_sheet(spark, tmp_path):
    path = tmp_path / "child.csv"
    path.write_text("CODE,URL\nab_044,https://drive.google.com/file/d/x\nab 45,https://drive.google.com/file/d/y\n")
    known = spark.createDataFrame([("AB-44",), ("AB-45",)], "code string")
    links, bad = S.child_links(S.read_rows(spark, str(path)), "AB", known)
    assert bad.count() == 0 and {r.code for r in links.collect()} == {"AB-44", "AB-45"}
    path.write_text("CODE,URL\nab_044,http://x/y\nzz-1,https://drive.google.com/file/d/y\nab-45,https://drive.google.com/file/d/y,more\nab-45,https://drive.google.com/file/d/y\n")
    _, bad = S.child_links(S.read_rows(spark, str(path)), "AB", known)
    assert {r.kind for r in bad.collect()} == {"url", "prefix", "width", "unknown", "repeated"}


def test_directory(spark):
    cells = spark.createDataFrame([(" ab ", "#F00", "https://www.google.com/url?q=https%3A%2F%2Fdrive.google.com%2Ffile%2Fd%2Fx", None), ("cd", "rgb(255,0,0)", "https://docs.google.com/spreadsheets/d/abc/edit", None), ("ef", "#ff0000", "http://x/y", "label"), ("gh", "#00ff00", "http://x/y", None)], "text string, color string, href string, anchor string")
    found = S.directory_links(cells, "#ff0000")
    assert {(r.prefix, r.kind) for r in found.collect()} == {("AB", "drive"), ("CD", "sheet"), ("EF", "opaque")}
    assert S.repeated_groups(found).count() == 0
    children = spark.createDataFrame([("CD-1", "http://d")], "code string, url string")
    table = S.manifest(found, children)
    assert sorted(r.state for r in table.collect()) == ["child", "resolved", "resolved", "unresolved"]
    assert {r.scope: r.n for r in K.source_summary(table).collect()} == {"group": 3, "record": 1}
    assert [tuple(r) for r in K.unresolved_sources(table).collect()] == [("group", "EF", "http://x/y")]


LISTING = """<div class="thumBox"><img src="/db/review/pac_s.jpg"><a href="/product/index.php?product_id=81"><img src="/db/ab/pac_s.jpg"></a>
<p>code: ab_0044</p><h5>First title</h5><!-- 出演: <span class="yaku"><a href="/x">one</a></span><span class="yaku"><a>two</a></span><br>other --><dl><dt>DVDリリース日</dt><dd>2026/7/1</dd></dl></div>
<div class="thumBox x"><a href="/product/index.php?product_id=82">no cover</a></div><div class="thumBox">nothing</div><a href="/product/index.php?product_id=99">side</a>"""
DETAIL = """<section id="works_pic"><h5> A  title </h5><img src="/db/review/pac_s.jpg"><img src="/db/ab/pac_s.jpg"></section><section id="works_txt"><dl><dt>作品番号 :</dt><dd> ab_0044 </dd><dt>出演女優</dt><dd><a>one</a> <a>one</a><a>two</a></dd><dt>DVDリリース日</dt><dd>2026/07/01</dd></dl></section>
<div id="tag"><div id="tag_header">ジャンルタグ</div><a href="../search/index.php?tag_id=6">x  y</a><a href="../search/index.php?tag_id=6">again</a><a href="../search/index.php?actor_id=1">no</a></div><div id="tag"><div id="tag_header">other</div><a href="../search/index.php?tag_id=7">z</a></div>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, LISTING), (2, DETAIL), (3, None), (4, "<p>")], "page_id long, html string")
    cards = {r.at: r for r in P.listing_cards(pages).where("page_id = 1").collect()}
    assert len(cards) == 3 and [cards[i].parsed for i in range(3)] == [True, False, False] and [cards[i].product_id for i in range(3)] == [81, 82, None]
    assert (cards[0].code, cards[0].title, cards[0].actors, cards[0].release_date, cards[0].cover) == ("AB-44", "First title", ["one", "two"], "2026-07-01", "https://www.example.com/db/ab/pac_s.jpg")
    again = P.listing_records(P.listing_cards(spark.createDataFrame([(1, LISTING + LISTING.replace("First", "Second"))], "page_id long, html string")))
    assert [(r.product_id, r.title) for r in again.collect()] == [(81, "First title")]
    details = {r.page_id: r for r in P.detail_records(pages).collect()}
    assert (details[2].code, details[2].title, details[2].actors, details[2].release_date) == ("AB-44", "A title", ["one", "two"], "2026-07-01") and details[3].code is None and details[4].code is None
    assert details[2].cover == "https://www.example.com/db/ab/pac_s.jpg"
    assert [tuple(r) for r in P.page_tags(pages).collect()] == [(2, 6, "genre", "x y")]
    bodies = [(1, "é".encode(), None), (2, "日本".encode("cp932"), None), (3, "é".encode("latin-1"), "text/html; charset=latin-1"), (4, b'<meta charset="shift_jis">' + "日".encode("shift_jis"), None), (5, b"\xff\xff\x81", None), (6, None, None), (7, "é".encode(), "text/html; charset=us-ascii"), (8, b'<meta charset="none-such">x', None), (9, "é".encode("latin-1"), 'text/html; charset="latin-1"')]
    got = {r.page_id: r.html for r in P.decoded(spark.createDataFrame(bodies, "page_id long, body binary, content_type string")).collect()}
    assert got == {1: "é", 2: "日本", 3: "é", 4: '<meta charset="shift_jis">日', 5: None, 6: None, 7: None, 8: None, 9: "é"}


def test_snapshot_round_trip(spark, tmp_path):
    doc = {"schemaVersion": 1, "generatedAt": "2024-01-01T00:00:00Z", "series": [{"code": "A", "count": 1, "links": {"subtitle": "http://d"}, "videos": [{"code": "A-1", "number": 1, "title": "t", "actors": ["x"], "links": {"gofile": "http://g", "uncensored": {"gofile": "http://u"}}}]}]}
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc))
    document = N.read_document(spark, str(path))
    flat = N.flatten(document)
    assert flat.first().code == "A-1" and flat.first().series == "A"
    assert {(r.scope, r.provider, r.url) for r in N.record_links(flat).collect()} == {("", "gofile", "http://g"), ("uncensored", "gofile", "http://u")}
    assert [tuple(r) for r in N.group_links(document).collect()] == [("A", "subtitle", "http://d")] and N.load_model(flat).count() == 1
    rec = spark.createDataFrame([("A-2", "A", 2, "2024-01-02"), ("A-1", "A", 1, "2024-01-01"), ("B-1", "B", 1, "2024-01-02")], "code string, prefix string, number long, release_date string")
    out = [json.loads(r.value) for r in K.document_lines(rec, R.build_groups(rec), {"schemaVersion": 1}).collect()]
    assert out[0] == {"schemaVersion": 1} and [s["code"] for s in out[1:]] == ["A", "B"] and [v["code"] for v in out[1]["videos"]] == ["A-1", "A-2"]
    text = [r.value for r in K.document_lines(rec.repartition(3), R.build_groups(rec), {"schemaVersion": 1}).collect()]
    assert text == [json.dumps(x, sort_keys=True, separators=(",", ":")) for x in out]


def test_legacy_and_maps(spark, tmp_path):
    (tmp_path / "data.json").write_text(json.dumps({"AB": [{"code": "ab_1", "title": "t", "date": "2024-01-01"}, None], "CD": [{"code": "bad"}]}))
    (tmp_path / "links.json").write_text(json.dumps({"ab_1": {"st": " http://s ", "gf": "", "other": "http://o"}}))
    records, links = N.read_legacy(spark, str(tmp_path / "data.json"), str(tmp_path / "links.json"))
    assert [tuple(r)[:3] for r in records.collect()] == [("AB-1", "t", "2024-01-01")]
    assert {(r.provider, r.url) for r in links.collect()} == {("streamtape", "http://s"), ("other", "http://o")}
    (tmp_path / "map.json").write_text(json.dumps({"a": 1, "b": "x"}))
    assert {(r.key, r.value) for r in N.read_override_map(spark, str(tmp_path / "map.json")).collect()} == {("a", "1"), ("b", "x")}
    (tmp_path / "state.json").write_text(json.dumps({"inputs": {"s": "h"}, "official": {"lastAuditAt": "nonsense"}}))
    assert N.read_prior_state(spark, str(tmp_path / "state.json")).first().last_audit is None
    a, b = spark.createDataFrame([("x", "u")], "label string, url string"), spark.createDataFrame([("y", "v")], "label string, url string")
    assert N.resources(a, b).first().label == "y" and N.resources(a, None).first().label == "x" and N.resources(a, b.limit(0)).first().label == "x"
    good, bad = spark.createDataFrame([(1, "genre", "a")], "id long, group string, name string"), spark.createDataFrame([(1, "genre", "a"), (1, "genre", "b")], "id long, group string, name string")
    assert N.stored_tags(None, a) is a and N.stored_tags(good, a) is good and N.stored_tags(bad, a) is a


def test_publish(spark, tmp_path):
    root, df = str(tmp_path / "pub"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert K.current(spark, root) is None
    assert K.publish(spark, root, "s1", {"records": df}, dry_run=True) and K.current(spark, root) is None
    assert not K.publish(spark, root, "s1", {"records": df}, violations=df) and K.current(spark, root) is None
    assert K.publish(spark, root, "s1", {"records": df}, violations=df.limit(0)) and K.publish(spark, root, "s2", {"records": df.withColumn("v", F.lit("b"))})
    assert K.current(spark, root) == "s2" and K.read_current(spark, root, "records").first().v == "b"
    assert K.should_publish("audit", True, "a", "a") and not K.should_publish("incremental", True, "a", "a") and K.should_publish("links-only", False, "a", "a", "x", "y")


def test_hashes_and_manifests(spark, tmp_path):
    a = spark.range(500).withColumn("m", F.col("id") % 7)
    first = K.content_hash(a).first().hash
    assert first == K.content_hash(a.repartition(7, F.rand(1)).select("m", "id")).first().hash != K.content_hash(a.unionByName(a.limit(1))).first().hash
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.txt").write_text("one")
    (tmp_path / "f" / "y.txt").write_text("two")
    before = K.file_manifest(spark, str(tmp_path / "f"))
    rows = [tuple(r) for r in before.collect()]
    assert sorted(r[0] for r in rows) == ["x.txt", "y.txt"]
    fixed = spark.createDataFrame(rows, before.schema)
    (tmp_path / "f" / "y.txt").write_text("2")
    (tmp_path / "f" / "z.txt").write_text("3")
    after = K.file_manifest(spark, str(tmp_path / "f"))
    assert {(r.path, r.state) for r in K.compare_manifests(fixed, after).collect()} == {("y.txt", "different"), ("z.txt", "extra")}
    assert K.manifest_hash(fixed).first() != K.manifest_hash(after).first()
    log = K.log_row(spark.createDataFrame([(1, 2, 3, 0)], "added long, updated long, retained long, deleted long"), "s1", "audit", "2024-01-01T00:00:00Z", {"a": "h"})
    K.append_log(log, str(tmp_path / "log"))
    assert K.human_summary(spark.read.parquet(str(tmp_path / "log"))).first().summary == "audit: 1 added, 2 updated, 3 retained, 0 deleted"


def catalog(spark):
    rec = spark.createDataFrame([("AB-1", "AB", 1, "Red ＢＯＬＴ", ["Ann"], "2024-01-01", [1]), ("AB-3", "AB", 3, "other", ["Bob"], "2024-01-03", [2, 1]), ("CD-1", "CD", 1, "bolt", [], "2024-02-01", [])], "code string, prefix string, number long, title string, actors array<string>, release_date string, tag_ids array<long>")
    tags = spark.createDataFrame([(1, "genre", "源", "Source"), (2, "character", "b", "Sky blue")], "id long, group string, name string, translation string")
    links = spark.createDataFrame([("AB-1", "", "gofile", "http://g")], "code string, scope string, provider string, url string")
    log = spark.createDataFrame([("2024-01-01T00:00:00Z", 1), ("2024-02-01T00:00:00Z", 2)], "generated_at string, n int")
    return B.Catalog(rec, R.build_groups(rec), tags, links, log)


def test_browse(spark):
    c = catalog(spark)
    codes = lambda df: [r.code for r in df.collect()]
    assert codes(c.search("  bolt ")) == ["CD-1", "AB-1"] and codes(c.search("ab_003")) == ["AB-3"] and codes(c.search("ann")) == ["AB-1"] and codes(c.search("source")) == ["AB-1", "AB-3"] and codes(c.search(" ")) == []
    assert [r.id for r in c.search_tags("SKY").collect()] == [2] and c.search_tags("sky", "genre").count() == 0 and c.search_tags("").count() == 0 == c.search_tags(" 　", "genre").count()
    assert codes(c.get_record("ab_1")) == ["AB-1"] and c.get_group(" ab").count() == 1 and c.get_tag(2).count() == 1 and c.get_tags("none").count() == 0
    assert [r.prefix for r in c.recent_groups(1).collect()] == ["CD"] and codes(c.group_view("ab")) == ["AB-1", "AB-3"] and c.group_view("ab", True).count() == 99
    one = c.detail("AB-1").first()
    assert [(g.group, [t.name for t in g.tags]) for g in one.tag_groups] == [("genre", ["源"])] and one.link_groups[0].badges[0].provider == "gofile" and c.metadata().first().n == 2
    assert codes(B.filter_by_tags(c.records, [1, 2])) == ["AB-3"] and codes(B.filter_by_tags(c.records, [1], [2])) == ["AB-1"] and len(codes(B.filter_by_tags(c.records, []))) == 3 and len(codes(B.filter_by_tags(c.records, [2, True, -1], match="any"))) == 1
    pairs = c.records.select("code", F.explode("tag_ids").alias("tag_id"))
    assert codes(B.codes_by_tags(pairs, [1, 2])) == ["AB-3"] and codes(B.codes_by_tags(pairs, [1], [2])) == ["AB-1"]
    assert codes(c.records.orderBy(*B.newest())) == ["CD-1", "AB-3", "AB-1"] and codes(c.records.orderBy(*B.oldest()))[0] == "AB-1" and codes(c.records.orderBy(*B.natural()))[-1] == "CD-1"
    assert codes(c.group_page("ab", 1, 5)[0]) == ["AB-3"] and c.group_page("ab", 0, 1)[1]["next"] == 1
    twice = B.Catalog(c.records.unionByName(c.records.where("code = 'AB-1'").withColumn("number", F.lit(9).cast("bigint"))), c.groups, c.tags, c.links)
    assert [(r.code, r.number) for r in twice.search("ann").collect()] == [("AB-1", 1)]
    assert [(r.code, r.place) for r in B.placed(c.records.select("code"), [F.desc("code")]).orderBy("place").collect()] == [("CD-1", 1), ("AB-3", 2), ("AB-1", 3)]
    state = spark.createDataFrame([("CD-1", 1), ("AB-1", 2), ("AB-3", 0), ("ZZ-1", 1)], "code string, state int")
    assert [(r.code, r.state) for r in B.favourites(state, c.records).collect()] == [("CD-1", 1), ("AB-1", 2)]
    manifest = spark.createDataFrame([("AB-1", "AB/AB-1.webp"), ("AB-3", "x")], "code string, path string")
    assert codes(B.covers_accepted(manifest, c.records, F.concat_ws("/", "prefix", F.concat("code", F.lit(".webp"))))) == ["AB-1"]


def test_files_do_not_depend_on_rows_of_other_files(spark, tmp_path):
    """Each sort spills every 200 rows, as it does where a task holds many files; merged runs leave ties in any order."""
    conf, key = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    rows, found = spark.range(3000).selectExpr("id % 7 AS f", "concat('ORD-', id) AS value"), {}
    conf.set(key, "200")
    try:
        for side, without in (("a", 3), ("b", 2)):
            K.write_lines(rows.where(F.col("f") != without), "f", str(tmp_path / side))
    finally:
        conf.remove(key)
    for side in ("a", "b"):
        found[side] = K.file_manifest(spark, str(tmp_path / side)).where("path like 'f=%'").select(F.regexp_extract("path", "f=([0-9]+)", 1).alias("path"), "hash")
    assert sorted(map(tuple, K.compare_manifests(found["a"], found["b"]).collect())) == [("2", "missing"), ("3", "extra")]


def test_plain_markup_is_read_like_any_other():
    """the fast reader gives what the general parser gives, or passes; nesting of any depth is read."""
    bits = ["<p>", "</p>", '<div class="a B">', "</div>", '<img src="x.jpg">', "</br>", "text ", "a &amp; b", "&am", "<!-- c -->", "<!--x<b>y</b>-->", "<!-->", "<!-- a--b -->", "<script>", "</script>", "if (a<b)", "<a href='q'>", '<a href="q?a=1&b=2">', "</a>", "<br/>", '<h1 ID="t">', "</h1>", "<", ">", "<title>", "</title>", "<a b>", '<a x="1" x="2">', "</p >"]
    rng, plain = random.Random(1), 0
    shown = lambda page: [(e.tag, e.attrs, e.classes, e.text(), [x.tag for x in e.all()]) for e in page]
    for _ in range(3000):
        html = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        found = P._plain(html)
        if found is not None:
            plain += 1
            assert shown(P._closed(found)) == shown(P._any(html)), html
    assert plain > 300 and P._plain(LISTING) is not None
    deep = "<div>" * 3000 + '<div class="thumBox"><h5>x</h5>'
    assert [e.text() for e in P._tree(deep) if "thumbox" in e.classes] == ["x"] == [e.text() for e in P._any(deep) if "thumbox" in e.classes]
