import hashlib
import random

from pyspark.sql import functions as F

from recordkeep.llm.line_dedup import line_dedup

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, min_docs=2):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or len(key(x)) < 10 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup(df, **kw).collect()), key=repr)


ROWS = [
    (5, "A shared line here\nown five\n\n"),
    (3, "  a SHARED line here\t\nanother one, longer\nA shared line here"),
    (7, "É shared ligne ici\né shared ligne ici\nshort\nshort"),
    (8, None),
    (9, ""),
    (None, "a shared line here\nonly in a row without id"),
    (11, "another one, longer\x0b"),
    (11, "another one, longer\nsecond text of the same id"),
    (11, "another one, longer\nsecond text of the same id"),
    (12, "x" * 300000 + "\n" + "a shared line here" + "\n" * 5000),
    (13, "a shared line here"),
]


def test_against_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_higher_threshold(spark):
    assert run(spark, ROWS, min_docs=4) == brute(ROWS, 4)


def test_random_documents(spark):
    rng = random.Random(1)
    pool = [f"line number {i} of the pool" for i in range(40)] + ["tiny", "", "  Line number 3 of the pool "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "the same long line", 4, "k"), (2, "the same long line", 5, "m")], "doc_id long, text string, n_lines int, row string").withColumn("lines", F.lit(1)).withColumn("lost", F.lit("x"))
    got = {r.doc_id: r for r in line_dedup(df).collect()}
    assert (got[2].text, got[2].n_lines, got[2].n_dropped, got[2]["row"], got[2].lines, got[2].lost) == ("", 1, 1, "m", 1, "x")
    assert hashlib.sha256(b"").hexdigest() and got[1].text == "the same long line"
