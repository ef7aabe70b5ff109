from pyspark.sql import functions as F

from recordkeep.functions import keys, text, urls, values


def apply(spark, f, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_codes(spark):
    got = apply(spark, keys.normalize_code, [" ab_007 ", "a1-0", "AB 12", "AB--12", "12-3", "AB-12x", None, "AB-00000000000000000000123", "　ab-1"])
    assert got == ["AB-7", "A1-0", "AB-12", None, None, None, None, "AB-123", "AB-1"]
    assert apply(spark, keys.extract_code, ["see ab - 012b now", "xab-1-2", "no", "G1-0007."]) == ["AB-12B", None, None, "G1-7"]
    assert apply(spark, keys.normalize_code_query, ["ａｂ－００７", "AB-1"]) == ["AB-7", "AB-1"]
    assert apply(spark, keys.code_prefix, ["AB-7", "A-B-7"]) == ["AB", "A-B"] and apply(spark, keys.code_number, ["AB-7", "AB-7B"]) == [7, None]
    assert apply(spark, keys.normalize_prefix, [" ab1 ", "a b", "1a"]) == ["AB1", None, None]
    assert apply(spark, keys.canonical_code, ["AB-7", "ab-7", "AB-07"]) == ["AB-7", None, None]
    rows = spark.createDataFrame([(None, "AB-7B"), (3, "AB-7"), (-1, "x")], "n long, c string")
    assert [r[0] for r in rows.select(keys.record_number(F.col("n"), F.col("c"))).collect()] == [7, 3, 2**63 - 1]


def test_text(spark):
    assert apply(spark, text.normalize_text, ["  Ａ  b\n", None, "ÉÉ"]) == ["a b", "", "éé"]
    assert apply(spark, text.damaged, ["ok", "a�", "涓", "涓x涓", None]) == [False, True, False, True, False]
    assert apply(spark, text.header_name, ["﻿ new code ", "x"]) == ["NEW CODE", "X"] and apply(spark, text.label, [" a : b：", ""]) == ["ab", ""]
    assert apply(spark, text.distinct_names, [[" a", "b", "a", "", " "]], "array<string>") == [["a", "b"]]
    assert apply(spark, lambda c: text.summary(c, 2), [["a"], ["a", "b", "c", "d"], []], "array<string>") == ["a", "a, b +2", ""]
    a = spark.createDataFrame([(1, {"x": 1, "y": 2})], "k int, m map<string,int>")
    b = spark.createDataFrame([({"y": 2, "x": 1}, 1)], "m map<string,int>, k int")
    assert a.select(text.fingerprint(a)).first() == b.select(text.fingerprint(b)).first()


def test_values(spark):
    assert apply(spark, values.positive_int, ["12", "0", "-3", "12.7", "x", None]) == [12, None, None, None, None, None]
    assert apply(spark, values.nonnegative_int, ["0", "-1"]) == [0, None]
    assert apply(spark, values.valid_date, ["2024-02-29", "2023-02-29", "2024-2-3", "x", None]) == [True, False, False, False, False]
    assert apply(spark, values.normalize_date, ["on 2024/2/3.", "2024-12-01", " later "]) == ["2024-02-03", "2024-12-01", "later"]
    assert apply(spark, values.valid_instant, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-13-02T03:04:05Z", None]) == [True, False, False, False]
    assert apply(spark, values.clean_ids, [[3, 1, 3, -2, 0]], "array<bigint>") == [[1, 3]]
    rows = spark.createDataFrame([(5, "2024-01-01"), (None, "2024-01-01"), (5, None)], "n long, d string")
    assert [r[0] for r in rows.select(values.in_scope(F.col("n"), F.col("d"), 1, 5, "2023-01-01")).collect()] == [True, False, False]


def test_urls(spark):
    assert apply(spark, urls.valid_url, ["http://a/b", "https://a", "ftp://a", "http://", "http://a b", None, "http://a/\x01"]) == [True, True, False, False, False, False, False]
    assert apply(spark, urls.safe_url, [" http://a/b ", "javascript:x"]) == ["http://a/b", None]
    got = apply(spark, urls.unwrap_redirect, ["https://www.google.com/url?q=http%3A%2F%2Fx%2Fy&z=1", "https://google.com/url?q=a&q=b", "https://google.com/url", "http://x/y", "bad"])
    assert got == ["http://x/y", None, None, "http://x/y", None]
    got = apply(spark, urls.destination, ["https://drive.google.com/drive/folders/ab_1/", "https://drive.google.com/file/d/a-1/view", "https://drive.google.com/open?id=a", "https://drive.google.com/open?id=a&id=b", "https://docs.google.com/spreadsheets/d/abc/edit", "http://x/y"])
    assert got == ["drive", "drive", "drive", "opaque", "sheet", "opaque"]
    base = "https://docs.google.com/spreadsheets/d/abc/edit"
    got = apply(spark, urls.export_url, [base, base + "?gid=7#gid=7", base + "?gid=7#gid=8", base + "#gid=x", "http://x"])
    assert got == ["https://docs.google.com/spreadsheets/d/abc/export?format=csv&gid=0", "https://docs.google.com/spreadsheets/d/abc/export?format=csv&gid=7", None, None, None]
    assert apply(spark, lambda c: urls.query_id(c, "/search/index.php", "tag_id"), ["../search/index.php?tag_id=6", "/search/index.php?tag_id=0", "/x.php?tag_id=6", "/search/index.php?tag_id=1&tag_id=2"]) == [6, None, None, None]
    make = lambda c: urls.preview_base(c, "www.example.com", "db")
    assert apply(spark, make, ["https://www.example.com/db/ab/pac_s.jpg", "http://www.example.com/db/ab/pac_s.jpg", "https://www.example.com/db/pac_s.jpg", "https://www.example.com/db/ab/pac_s.jpg?x"]) == ["https://www.example.com/db/ab/sample/", None, None, None]
    assert apply(spark, lambda c: urls.is_preview_base(c, "www.example.com", "db"), ["https://www.example.com/db/ab/sample/", "https://www.example.com/db/ab/other/", None]) == [True, False, False]
    assert apply(spark, lambda c: urls.preview_urls(F.lit("b/"), c, 2, 9), [18, 3, 1], "int") == [[f"b/{i:03d}_l.jpg" for i in range(2, 8)], ["b/002_l.jpg", "b/003_l.jpg"], []]
    assert apply(spark, lambda c: urls.pick_cover(c, F.lit("AB-1")), [["http://h/review/p.jpg", "http://h/ab/p.jpg"], ["http://h/x/p.jpg"], []], "array<string>") == ["http://h/ab/p.jpg", "http://h/x/p.jpg", None]
    assert apply(spark, urls.normalize_color, ["#ABC", "#aabbcc", "rgb(255, 0, 10)", "rgb(256,0,0)", "red"]) == ["#aabbcc", "#aabbcc", "#ff000a", None, None]
    assert apply(spark, lambda c: urls.eligible_cover(c, "h.example", "db"), ["https://h.example/db/x.jpg", "http://h.example/db/x.jpg", None]) == [True, False, False]


def test_digits_and_spaces_of_any_script(spark):
    typed = ["AB-１２", "ab_٠٠٧ ", "AB-1²", "AB-𝟘𝟙", "AB　7", "ＡＢ-7"]
    assert apply(spark, keys.normalize_code, typed) == ["AB-12", "AB-7", None, "AB-1", "AB-7", None]
    assert apply(spark, keys.extract_code, ["見よ ABC　-　１２ｂ", "ABC - 1２b.", "x"]) == ["ABC-12", "ABC-12B", None] and keys.code_of("ab　１２") == "AB-12"
