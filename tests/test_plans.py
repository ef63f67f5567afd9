"""What the physical plans must look like."""

import os
import re

import pytest

from clipsight.functions import series as S
from clipsight.operators import kinematics
from clipsight.plans import registered
from clipsight.plans.registry import Tables

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(q.run(Tables(spark, FOLDER))) for name, q in registered.QUERIES.items()}


def test_no_products_and_no_row_at_a_time_python(plans):
    for name, plan in plans.items():
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in plan, (name, bad)


def test_at_most_one_job_before_a_query_runs(spark):
    """Plans are not decided by running their inputs: one look at the keys of an ordered scan at most."""
    seen = spark._jsparkSession.sharedState().statusStore()
    spark.range(1).collect()
    assert seen.executionsCount() > 0
    for name, query in registered.QUERIES.items():
        if query.writes:
            continue
        before = seen.executionsCount()
        query.run(Tables(spark, FOLDER))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        since = seen.executionsList(before, 1000)
        # Commands such as naming a view run no job.
        ran = [i for i in range(since.size()) if since.apply(i).jobs().size()]
        assert len(ran) <= 1, name


def test_python_only_where_stated(plans):
    used = {n for n, p in plans.items() if "ArrowEvalPython" in p or "InPandas" in p or "InArrow" in p}
    calls, products = {"batch_enrich", "batch_tally", "batch_journal"}, {"motion_check", "poses_from_actions"}
    assert used - {n for n, q in registered.QUERIES.items() if q.writes} == calls - {"batch_journal"} | products


@pytest.mark.parametrize("name", ["verdict_parse", "last_sentence", "expectation_classify", "label_by_path", "path_parts",
                                  "output_path", "subtree_filter", "job_lines", "upload_manifest", "unwrap_prompt",
                                  "time_range_rules", "marker_checks", "traj_parse_errors", "traj_trim", "series_unpivot",
                                  "clip_duration", "prompt_assembly", "poses_from_actions", "document_parts"])
def test_row_local_queries_do_not_shuffle(plans, name):
    assert "Exchange" not in plans[name]


@pytest.mark.parametrize("name", ["kinematics_native", "kinematics_5hz", "initial_speed", "traj_windows", "axis_range",
                                  "time_axis", "flag_log_parse", "label_last", "eval_counts", "both_rates"])
def test_one_shuffle_is_enough(plans, name):
    assert len(re.findall(r"\bExchange hashpartitioning", plans[name])) == 1


@pytest.mark.parametrize("name, columns", [
    ("kinematics_native", {"event_id", "value"}),
    ("verdict_parse", {"doc_id", "text"}),
    ("pending_anti", {"event_id"}),
    ("marker_checks", {"doc_id", "text"}),
    ("job_lines", {"event_id"}),
])
def test_only_needed_columns_are_read(plans, name, columns):
    read = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)", plans[name]).group(1)))
    assert read == columns


def test_long_clip_check_reaches_the_scan(spark, tmp_path):
    schema = "clip int, k int, px double, pz double, fx double, fz double"
    spark.createDataFrame([(1, k, 0.0, float(k), 0.0, 1.0) for k in range(5)], schema).write.parquet(str(tmp_path / "p"))
    poses = spark.read.parquet(str(tmp_path / "p"))
    assert "GreaterThanOrEqual(k,1000)" in plan_of(poses.filter("k >= 1000"))
    got = kinematics.speed_heading(poses, "clip").collect()
    assert [r.v for r in got] == [round(10 * S.MPH_PER_MPS, 4)] * 4
