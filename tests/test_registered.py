"""Every registered query against its reference SQL on the smallest tables."""

import os

import pytest
from compare import compare, database

from clipsight.plans import registered
from clipsight.plans.registry import Tables

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not here")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in registered.QUERIES.items() if q.sql])
def test_query_matches_sql(spark, con, name):
    query = registered.QUERIES[name]
    problem = compare(query.run(Tables(spark, FOLDER)), con, query.sql)
    assert problem in (None, "no rows"), problem


@pytest.fixture(scope="module")
def tight(spark):
    """Limits so low that every key is heavy and no side may be broadcast."""
    limits = {"rowsPerTask": "40"}
    for name, value in limits.items():
        spark.conf.set(f"spark.clipsight.{name}", value)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for name in limits:
        spark.conf.unset(f"spark.clipsight.{name}")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


SKEW_AWARE = [
    "allowed_prompts", "asof_samples", "cursor_clamp", "cursor_irregular", "eval_metrics", "experiment_report", "heuristic_status", "invariant_sweep",
    "kinematics_5hz", "kinematics_native", "label_lookup", "label_upsert", "motion_check", "nearest_prompt_file",
    "next_unskipped", "pending_anti", "prompt_sentence", "queue_position", "skip_filter", "time_axis", "traj_check",
    "variation_cross",
]


@pytest.mark.parametrize("name", SKEW_AWARE)
def test_query_matches_sql_when_everything_is_heavy(tight, con, name):
    query = registered.QUERIES[name]
    problem = compare(query.run(Tables(tight, FOLDER)), con, query.sql)
    assert problem in (None, "no rows"), problem


def test_every_query_has_sql():
    assert [n for n, q in registered.QUERIES.items() if not q.sql] == []


def test_entry_points(spark):
    import __spark_entry__ as points

    assert set(points.oracle_sql()) <= set(points.queries())
    assert points.entry(spark).count() > 0
