import json

from pyspark.sql import functions as F

from recordkeep.sources import documents as D
from recordkeep.sources import sinks, snapshots

KIND = "code string, prefix string, number long, title string, actors array<string>, release_date string, cover string, product_id long, preview_base string, preview_count int, tag_ids array<long>, tags_status string, tags_updated_at string, tags_source string"


def tables(spark, rows, links=(), group_links=(), tags=()):
    header = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", {"records": len(rows)}, "incremental", {"label": 'Por"tal'})], "schemaVersion int, generatedAt string, totals map<string,long>, refresh string, resources map<string,string>")
    full = [(c, c.split("-")[0], int(c.split("-")[1]), t, a, d, None, None, None, None, ids, None, None, None) for c, t, a, d, ids in rows]
    return D.Tables(
        header,
        spark.createDataFrame(full, KIND),
        spark.createDataFrame(list(links), "code string, scope string, provider string, url string"),
        spark.createDataFrame(list(group_links), "prefix string, provider string, url string"),
        spark.createDataFrame(list(tags), "id long, `group` string, name string, translation string, count long"),
    )


ROWS = [("AB-1", 'Quo"te\n, \\ ］', ["Ann", "Bo"], "2024-01-01", [2, 1]), ("AB-2", None, [], None, None), ("CD-10", "x", ["é"], "2024-02-01", []), ("CD-9", "y", None, "2023-02-01", [1])]
LINKS = [("AB-1", "", "gofile", "http://g/1?a=\"b\""), ("AB-1", "uncensored", "gofile", "http://u/1"), ("AB-1", "", "streamtape", "http://s/1"), ("CD-9", "uncensored", "gofile", "http://u/9")]
GROUPS = [("AB", "subtitle", "http://d/ab"), ("ZZ", "subtitle", "http://d/zz")]
TAGS = [(1, "genre", "源", "Source", 2), (2, "character", "b", "Sky", 1)]


def same(a, b):
    for name in ("header", "records", "links", "group_links", "tags"):
        x, y = getattr(a, name), getattr(b, name)
        maps = [c for c, t in x.dtypes if t.startswith("map")]
        x, y = (df.withColumns({c: F.to_json(c) for c in maps}) if maps else df for df in (x, y.select(*x.columns)))
        assert sinks.content_hash(x).first() == sinks.content_hash(y).first(), name


def test_round_trip(spark, tmp_path):
    t = tables(spark, ROWS, LINKS, GROUPS, TAGS)
    D.export(t, str(tmp_path / "doc"))
    same(t, D.read(spark, str(tmp_path / "doc")))
    text = [json.loads(line) for p in sorted((tmp_path / "doc").glob("part-*")) for line in p.read_text(encoding="utf-8").splitlines()]
    assert [x["place"] for x in text] == list(range(1, len(text) + 1)) and text[0]["snapshot"]["lines"] == len(text)
    assert [x.get("record", {}).get("code", x.get("group", {}).get("code")) for x in text[1:8]] == ["CD", "CD-9", "CD-10", "AB", "AB-1", "AB-2", "ZZ"]
    assert all(list(x) == sorted(x) for x in text)
    assert tuple(D.gaps(D.read_lines(spark, str(tmp_path / "doc"))).first()) == (len(text),) * 3


def test_the_nested_document_comes_back(spark, tmp_path):
    for k, t in enumerate((tables(spark, ROWS, LINKS, GROUPS, TAGS), tables(spark, ROWS[:1]), tables(spark, [], tags=TAGS), tables(spark, []))):
        path = tmp_path / f"d{k}"
        D.export(t, str(path))
        whole = "".join(r.value for r in D.fragments(D.read_lines(spark, str(path))).orderBy("place").collect())
        parsed = json.loads(whole)
        assert whole == json.dumps(parsed, ensure_ascii=False, sort_keys=True, separators=(",", ":")) and "\n" not in whole
        (tmp_path / f"w{k}.json").write_text(whole, encoding="utf-8")
        back = D.nested_tables(snapshots.read_document(spark, str(tmp_path / f"w{k}.json")))
        same(t, back)
        assert sum(g["count"] for g in parsed["series"]) == t.records.count()


def test_a_lost_part_is_seen(spark, tmp_path):
    t = tables(spark, [(f"AB-{k}", f"t{k}", [], "2024-01-01", []) for k in range(500)])
    D.export(t, str(tmp_path / "doc"), part=100)
    parts = sorted((tmp_path / "doc").glob("part-*"))
    assert len(parts) > 1 and D.read(spark, str(tmp_path / "doc")).records.count() == 500  # one group, several parts
    parts[1].unlink()
    (tmp_path / "doc" / f".{parts[1].name}.crc").unlink()
    found = D.gaps(D.read_lines(spark, str(tmp_path / "doc"))).first()
    assert found.stated == 502 > found.lines == found.places


def test_reading_is_pruned_and_split(spark, tmp_path):
    t = tables(spark, [(f"AB-{k}", f"t{k}", [], "2024-01-01", []) for k in range(2000)])
    D.export(t, str(tmp_path / "doc"), part=500)
    rows = D.read(spark, str(tmp_path / "doc")).records.select("code")
    assert rows.rdd.getNumPartitions() > 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<record:struct<code:string" in plan or "record:struct<code:string>" in plan
