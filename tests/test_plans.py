"""Shape of the physical plans, with small-table broadcasts switched off."""

import os

import pytest

import __spark_entry__ as entry
from trialspark.operators import attach, classify, markers, phases

DIRECTORY = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables not present")


@pytest.fixture
def no_small_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.LIBRARY))
def test_no_pairing_joins_and_no_sorted_aggregation(spark, no_small_broadcast, name):
    text = plan(entry.queries()[name](spark, DIRECTORY))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate", "ObjectHashAggregate", "Python"):
        assert operator not in text
    # forced broadcasts are the list of heavy trials, which a share of all rows bounds, and one
    # header for each listed file, which the driver holds
    for part in text.split("BroadcastExchange")[1:]:
        assert "_places" in part or "Subquery" in part and f"> {attach.SPLIT_ROWS}" in part


@pytest.mark.parametrize("name", ["enrich_full", "phase_prop", "phase_prop_norep", "refix_cells"])
def test_no_full_join_of_events(spark, no_small_broadcast, name):
    assert "FullOuter" not in plan(entry.queries()[name](spark, DIRECTORY))


def test_lag_shuffles_blocks_once(spark, no_small_broadcast):
    text = executed_scans(entry.queries()["dist_repeat"](spark, DIRECTORY))
    assert text.count("Exchange hashpartitioning(participant") - text.count("_block") <= 2
    assert len([x for x in text.splitlines() if "Exchange hashpartitioning(participant" in x and "_block" in x and "_w0" not in x and "CASE" not in x]) <= 2


def executed_scans(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_both_uses_of_the_markers_share_one_shuffle(spark, no_small_broadcast):
    text = executed_scans(entry.queries()["phase_prop"](spark, DIRECTORY))
    assert "ReusedExchange" in text and text.count("FileScan") <= 2  # the hits, the trials that get flags; markers for the hits are reused


def test_event_columns_are_pruned(spark, tmp_path):
    path = str(tmp_path / "fx")
    entry.queries()["load_fixations"](spark, DIRECTORY).selectExpr(
        "*", "'x' AS unused"
    ).write.parquet(path)
    events = classify.classify(spark.read.parquet(path)).where("response_corr = 1")
    marks = markers.trial_markers(events)
    text = plan(marks.select("participant", "tno", "fix_pattern"))
    assert "unused" not in text.split("ReadSchema:")[1] and "start_time" not in text.split("ReadSchema:")[1]
    assert "EqualTo(response_corr,1)" in text
    flags = plan(phases.trial_phase_flags(events, marks, ["dist_region"]))
    assert all("unused" not in part.splitlines()[0] for part in flags.split("ReadSchema:")[1:])
    assert flags.count("EqualTo(cat,Search)") >= 1


@pytest.mark.parametrize("name", ["trial_markers", "fix_pattern", "display_visits"])
def test_markers_take_one_shuffle(spark, no_small_broadcast, name):
    """Attributes are checked in the aggregation: events move once, as partial results, and nothing moves after."""
    text = executed_scans(entry.queries()[name](spark, DIRECTORY))
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1
    assert "Window" not in text and "Sort" not in text


def test_one_asof_pass_for_both_kinds(spark, no_small_broadcast):
    text = executed_scans(entry.queries()["sacc_first_search"](spark, DIRECTORY))
    assert text.count("FileScan") <= 2 and text.count("FullOuter") == 1
