import os

import pytest

import __spark_entry__

from recordkeep import queries as Q
from recordkeep.plans.lineage import cut, release

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_cut_and_release(spark):
    df = cut(spark.range(10).selectExpr("id", "cast(null as string) s"), "test", free=True)
    assert df.count() == 10 and df.inputFiles()
    assert release(spark) >= 1 and release(spark) == 0


#: Queries that set one row of counters, a stop or a hash beside other rows. Nothing else may meet without a key.
ONE_ROW = {"authoritative_scan", "gate_file_manifests", "gate_refresh_blocks", "gate_totals", "generation_errors", "refresh_counters", "scan_summary", "tag_sync_summary", "baseline_without_predecessor"}


@needs_tables
@pytest.mark.parametrize("name", [n for n in sorted(Q.QUERIES) if not n.startswith("stream")])
def test_no_product_of_rows(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and ("BroadcastNestedLoopJoin" not in text or name in ONE_ROW)


def test_scratch_and_shared_folder(spark):
    from recordkeep.plans.lineage import discard, scratch, shared_dir

    outer = cut(spark.range(3).toDF("id"), "outer")
    with scratch(spark):
        inner = cut(spark.range(4).toDF("id"), "inner")
        assert inner.count() == 4
    assert outer.count() == 3 and not os.path.exists(inner.inputFiles()[0].removeprefix("file://"))
    where = outer.inputFiles()[0].removeprefix("file://")
    discard(outer, outer)
    assert not os.path.exists(where)
    known = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == known.rstrip("/")


@needs_tables
def test_filters_and_columns_reach_the_scan(spark):
    text = plan(Q.QUERIES["tag_filter_all"](spark, SF))
    assert "PushedFilters: [In(l_suppkey, [1,2])]" in text and "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in text
    text = plan(Q.QUERIES["retain_links_only"](spark, SF))
    assert "Not(EqualTo(o_orderpriority,1-URGENT))" in text and "o_totalprice" not in text.split("ReadSchema")[1].split("\n")[0]


def _exchanges(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_rows_are_not_dealt_to_a_fixed_number_of_tasks(spark):
    """F12."""
    assert not [line for line in _exchanges(spark, "release_identity") if "RoundRobinPartitioning(3)" in line]


def test_links_of_each_side_are_made_once(spark):
    """three exchanges a side, for leaves, scopes and codes; twice as many and more before."""
    assert len(_exchanges(spark, "diff_links")) <= 6
