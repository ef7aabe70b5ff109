import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from recordkeep import queries as Q
from recordkeep.operators import gates as G
from recordkeep.operators import links as L
from recordkeep.streaming import overlay as X

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LEAF = "code string, scope string, provider string, url string, at int"


def write(spark, path, rows, k):
    spark.createDataFrame(rows, LEAF).coalesce(1).write.parquet(f"{path}/in/{k}")


def test_stream_overlay_equals_batch(spark, tmp_path):
    """Late rows included: the second and third batch bring rows that are older than what the state holds."""
    batches = [
        [("A-1", "", "x", "1", 1), ("A-2", "", "x", "late", 9), ("A-1", "", "x", "2", 3)],
        [("A-1", "", "x", "3", 4), ("A-2", "", "x", "old", 5), ("A-3", "", "y", "1", 5)],
        [("A-3", "", "y", "0", 4), ("A-4", "", "y", "1", 1)],
        [("A-4", "", "y", "2", 2)],
    ]
    for name, first_wins in (("new", False), ("old", True)):
        base = str(tmp_path / name)
        for k, rows in enumerate(batches):
            write(spark, base, rows, k)
            source = spark.readStream.schema(LEAF).option("recursiveFileLookup", "true").parquet(f"{base}/in")
            X.stream_overlay(source, f"{base}/state", f"{base}/cp", "at", first_wins, buckets=3).awaitTermination()
        got = {(r.code, r.provider): r.url for r in X.read_state(spark, f"{base}/state").collect()}
        every = spark.createDataFrame([r for rows in batches for r in rows], LEAF)
        want = every.groupBy(*L.LEAF).agg((F.min_by if first_wins else F.max_by)("url", "at").alias("url"))
        assert got == {(r.code, r.provider): r.url for r in want.collect()}
        kept = [p for p in (tmp_path / name / "state" / "data").glob("version=*/bucket=*")]
        assert len(kept) < 3 * len(batches)  # replaced buckets are gone
    assert X.read_state(spark, str(tmp_path / "nothing")) is None


def test_stream_new_records_and_gates(spark, tmp_path):
    spark.createDataFrame([("A-1", "2024-01-01 00:00:00"), ("A-1", "2024-01-01 00:00:05"), ("A-2", "2024-01-01 00:00:01")], "code string, ts string").select("code", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("code string, ts timestamp").parquet(str(tmp_path / "in"))
    q = X.new_records(source, "ts", "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.code for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A-1", "A-2"]
    fresh = X.unseen_batch(spark.read.parquet(str(tmp_path / "in")), spark.createDataFrame([("A-2",)], "code string"), "ts")
    assert [r.code for r in fresh.collect()] == ["A-1"]
    hashes = spark.readStream.schema("code string, ts timestamp").parquet(str(tmp_path / "in")).select(F.col("code").alias("name"), F.lit("x").alias("hash"))
    X.stream_gate_counts(hashes, G.hashes, str(tmp_path / "gates"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "gates")).first().n == 3


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    return float(v) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in Q.SQL:
        assert rows
        return
    out = duck.execute(Q.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted((tuple(cell(dict(zip(names, r, strict=True))[c]) for c in columns) for r in out.fetchall()), key=repr)
    assert rows == want
    assert rows, "a query without rows shows nothing"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.n == r.added + r.updated + r.retained for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
