import re
import threading

import pytest
from pyspark.sql import functions as F

from recordkeep.operators import refresh
from recordkeep.sources import hash_tree as H
from recordkeep.sources import sinks, versions


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "code string, v long")


def test_of_two_writers_one_fails(spark, tmp_path):
    root = str(tmp_path / "pub")
    sinks.publish(spark, root, "s1", {"t": frame(spark, ("A-1", 1))})
    base = versions.latest(spark, root)
    assert sinks.publish(spark, root, "s2", {"t": frame(spark, ("A-1", 2))}, base=base)
    with pytest.raises(versions.Conflict):
        sinks.publish(spark, root, "s2", {"t": frame(spark, ("A-1", 3))}, base=base)
    assert [(v["version"], v["parent"], v["snapshot_id"]) for v in versions.history(spark, root)] == [(1, 0, "s1"), (2, 1, "s2")]
    assert sinks.read_current(spark, root, "t").first().v == 2 and versions.read(spark, root, 1, "t").first().v == 1
    assert len(list((tmp_path / "pub" / "data").iterdir())) == 2  # the loser's folder is gone
    sinks.publish(spark, root, "s2", {"t": frame(spark, ("A-1", 4))})  # the same id again overwrites nothing
    assert versions.read(spark, root, 2, "t").first().v == 2 and sinks.read_current(spark, root, "t").first().v == 4


def race(spark, root, writers):
    gate, won, lost = threading.Barrier(writers), [], []

    def write(k):
        gate.wait()
        (won if versions.create_new(spark, f"{root}/x.json", f"{k}") else lost).append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(writers)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return won, lost


def test_racing_creators(spark, tmp_path):
    for k in range(5):
        won, lost = race(spark, f"{tmp_path}/r{k}", 8)
        assert len(won) == 1 and len(lost) == 7
        assert (tmp_path / f"r{k}" / "x.json").read_text() == str(won[0]) and len(list((tmp_path / f"r{k}").iterdir())) == 1


def test_a_store_that_only_renames(spark, tmp_path):
    (tmp_path / "far").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}/far")
    root = "viewfs://far/in/pub"
    assert versions.create_new(spark, f"{root}/a.json", "é") and not versions.create_new(spark, f"{root}/a.json", "2")
    assert (tmp_path / "far" / "pub" / "a.json").read_text() == "é"
    sinks.publish(spark, root, "s1", {"t": frame(spark, ("A-1", 1))})
    with pytest.raises(versions.Conflict):
        sinks.publish(spark, root, "s2", {"t": frame(spark, ("A-1", 2))}, base=0)
    assert sinks.read_current(spark, root, "t").first().v == 1


def saved(spark, df, path):
    H.save(df, ["code"], str(path))
    return df.withColumn("bucket", F.lit(0)).schema


def test_buckets_find_what_a_whole_diff_finds(spark, tmp_path):
    old = spark.range(3000).select(F.concat(F.lit("A-"), "id").alias("code"), (F.col("id") % 7).alias("v"))
    changed = F.when(F.col("code") == "A-5", 100).otherwise(F.col("v"))
    new = old.where("code <> 'A-17'").withColumn("v", changed).unionByName(frame(spark, ("B-1", 1)))
    schema = saved(spark, old, tmp_path / "old")
    saved(spark, new, tmp_path / "new")
    a, b = str(tmp_path / "old"), str(tmp_path / "new")
    got = H.changes(spark, a, b, schema)
    assert sorted(map(tuple, got.collect())) == [("A-17", "deleted"), ("A-5", "updated"), ("B-1", "added")] == sorted(map(tuple, refresh.diff(old, new).where("change <> 'retained'").collect()))
    assert tuple(H.counts(spark, b, got).first()) == (1, 1, 1, 2998) == tuple(refresh.diff_counts(refresh.diff(old, new)).first())
    levels = {}
    for r in H.differing(spark, a, b).collect():
        levels.setdefault(r.level, set()).add(r.bucket)
    assert levels[0] == {0} and len(levels[4]) <= 3 and len(levels[8]) <= 3 and {x >> 4 for x in levels[8]} == levels[4]
    odd = sorted(levels[8])
    scan = H.rows_of(spark, a, schema, odd)
    pruned = re.findall(r"PartitionFilters: \[([^\]]*)", scan._jdf.queryExecution().executedPlan().toString() + got._jdf.queryExecution().executedPlan().toString())
    assert len(pruned) >= 3 and all("bucket" in p for p in pruned)
    spark.sparkContext.setJobGroup("pruned", "pruned")
    ids = spark.sparkContext.statusTracker()
    scan.select("code").write.format("noop").mode("overwrite").save()
    tasks = sum(ids.getStageInfo(st).numTasks for j in ids.getJobIdsForGroup("pruned") for st in ids.getJobInfo(j).stageIds)
    assert tasks <= len(odd)  # 253 other folders are not opened


def test_equal_and_empty_tables(spark, tmp_path):
    old = spark.range(200).select(F.concat(F.lit("A-"), "id").alias("code"), F.col("id").alias("v"))
    for name, df in (("a", old), ("b", old.orderBy(F.desc("v")).repartition(3)), ("none", old.limit(0)), ("twice", old.unionByName(old.limit(1)))):
        schema = saved(spark, df, tmp_path / name)
    path = lambda n: str(tmp_path / n)
    assert H.root(spark, path("a")) == H.root(spark, path("b")) != H.root(spark, path("twice")) and H.root(spark, path("none")) is None
    same = H.changes(spark, path("a"), path("b"), schema)
    assert same.count() == 0 and tuple(H.counts(spark, path("b"), same).first()) == (0, 0, 0, 200)
    assert H.changes(spark, path("none"), path("a"), schema).where("change = 'added'").count() == 200 == H.changes(spark, path("a"), path("none"), schema).where("change = 'deleted'").count()


def test_two_identities_of_a_release(spark):
    head = lambda **f: spark.createDataFrame(list(f.items()), "field string, value string")
    same = lambda a, b: tuple(sinks.same_release(a, b).first())
    own = head(commit="a", files="h", config="c")
    assert same(own, own) == (True, True) and same(own, head(commit="b", files="h", config="c")) == (True, False)
    assert same(own, head(commit="a", files="x", config="c")) == (False, False) == same(own, head(commit="a", files="h")) and same(own, own.limit(0)) == (False, False)
