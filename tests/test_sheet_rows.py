import csv
import io
import random

from recordkeep.sources import sheets as S


def plain(text):
    return [(n, row) for n, row in enumerate(csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))) if row]


def got(spark, path):
    return sorted((r.row_no, r.cells) for r in S.read_rows(spark, str(path)).collect())


def test_rows_equal_a_plain_reader(spark, tmp_path):
    for k, text in enumerate(('a,b\n1,"x\ny",z\n\n"q""t",,\n,,\nlast', "﻿NEW CODE,x\r\n1,2\r\n", '"a\n\n\nb",c\n"",""\n " x ", y \n', "one", 'a,"b,c",d\n', "")):
        path = tmp_path / f"s{k}.csv"
        path.write_text(text, encoding="utf-8", newline="")
        assert got(spark, path) == plain(text), text


def test_a_file_of_many_splits(spark, tmp_path):
    rng = random.Random(1)
    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n")
    for k in range(3000):
        write.writerow([f"AB-{k}", "\n".join(rng.choice(["x", 'q"t', "", "a,b"]) for _ in range(rng.randrange(1, 6))), "é" * rng.randrange(0, 5), "end"])
    path = tmp_path / "big.csv"
    path.write_text(out.getvalue(), encoding="utf-8", newline="")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
        assert got(spark, path) == plain(out.getvalue())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_a_sheet_in_parts(spark, tmp_path):
    """files of a folder are one sheet, and a row may go on in the next of them."""
    for sheet, texts in {"s=1": ["a,b\n1,\"x\n", "y\",2\n", "\nlast\n"], "s=2": ["one\n"]}.items():
        (tmp_path / sheet).mkdir()
        for k, text in enumerate(texts):
            (tmp_path / sheet / f"part-{k:05}.txt").write_text(text)
    rows = S.read_sheets(spark, str(tmp_path), parts=True).collect()
    assert sorted((r.file[-3:], r.row_no, r.cells) for r in rows) == [("s=1", 0, ["a", "b"]), ("s=1", 1, ["1", "x\ny", "2"]), ("s=1", 3, ["last"]), ("s=2", 0, ["one"])]
