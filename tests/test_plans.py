"""Physical-plan properties of every registered query (sf0.001).

No cartesian products or nested-loop joins, no Python evaluation in the plan,
and the fixture scans read only the columns that they use.
"""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]
def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixture_scan_prunes_columns(spark):
    df = E.queries()["score_batch"](spark, SF)
    text = plan_text(df)
    assert "c_custkey" in text and "o_custkey" in text
    assert "c_name" not in text and "o_orderkey" not in text


def test_segment_breakdown_is_one_expand(spark):
    text = plan_text(E.entry(spark))
    assert text.count("Expand") == 1
