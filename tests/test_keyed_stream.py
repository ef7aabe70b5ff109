from pyspark.sql import functions as F

from recordkeep.operators import refresh
from recordkeep.streaming import keyed

KIND = "code string, at long"


def test_batches_and_a_restart_equal_the_batch_form(spark, tmp_path):
    snapshot = spark.createDataFrame([(f"A-{k}",) for k in range(0, 60, 3)] + [("A-0",), (None,)], "code string")
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    everything = None

    def land(part, rows):
        nonlocal everything
        df = spark.createDataFrame(rows, KIND)
        df.coalesce(1).write.mode("append").parquet(landed)
        everything = df if everything is None else everything.unionByName(df)

    def run(known=snapshot):
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(landed)
        with keyed.keyed_state(spark):
            q = keyed.unseen_stream(stream, known, "at").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    land(0, [(f"A-{k % 40}", 100 + k) for k in range(80)] + [(None, 1)])
    land(1, [("A-1", 5), ("A-50", 7), ("A-50", 6)])
    run()
    first = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert ("A-50", 6) in first and ("A-1", 101) in first  # a later batch never replaces what was let through
    land(2, [(f"A-{k}", k) for k in range(70)])
    run(snapshot.limit(0))  # what was known at the start stays known after a restart
    got = [r.code for r in spark.read.parquet(out).collect()]
    split = refresh.known_split(everything.where("code is not null"), snapshot, "code")
    assert len(got) == len(set(got)) and set(got) == {r.code for r in split.where("not is_known").select("code").distinct().collect()}
    assert spark.conf.get(keyed.PROVIDER) != keyed.ROCKS


def test_known_rows_on_demand(spark, tmp_path):
    spark.createDataFrame([("B", 2), ("A", 1), ("B", 1)], KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    with keyed.keyed_state(spark):
        q = keyed.unseen_stream(stream, spark.createDataFrame([("A",)], "code string"), "at", keep_known=True).writeStream.format("memory").queryName("known_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("known_rows").select("code", "at", F.col("is_known")).collect())) == [("A", 1, True), ("B", 1, False)]
