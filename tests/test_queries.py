"""Every registered query against its SQL twin, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from fleetlake.plans import registry
from compare import check
from conftest import SF

QUERIES, ORACLE = registry.QUERIES, registry.ORACLE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql_twin(spark, duckdb_tables, name):
    problem = check(spark, duckdb_tables, SF, name, QUERIES[name], ORACLE.get(name))
    # At this size some rules find nothing; an empty answer is right when the twin is empty too.
    assert problem in ("", "no rows")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("t1", "t2", "t3", "t4", "t7", "s2"))))
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_range_query_prunes_and_pushes_down(spark):
    from fleetlake.operators.filters import events_between
    from fleetlake.plans import inputs

    rows = events_between(inputs.index(spark, SF), "2024-01-05", "2024-01-06", "7").select("event_id")
    plan = rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "EqualTo(device_id,7)" in plan and "GreaterThanOrEqual(event_time" in plan
    assert "event_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    schema = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "battery" not in schema and "log_line" not in schema


def test_top_per_device_is_trimmed_before_the_shuffle(spark):
    plan = QUERIES["l1_newest_per_device"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j1_payload_join", "q9_payload_stats", "q9_payload_health", "q10_correlation", "i1_modem_connectivity"])
def test_payloads_are_read_once_and_stay_in_their_buckets(spark, name):
    """The archive is scanned once and never shuffled or sorted by its receipt; only the events move to its buckets."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as it is at any size but this one
    try:
        plan = plan_of(QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Bucketed: true") == 1
    below = initial.split("Bucketed: true")[0].split("SortMergeJoin")[-1]
    assert "archived_fw_version" not in "".join(line for line in initial.splitlines() if "Exchange" in line)
    assert "Window" not in below


def test_counts_take_one_scan_and_one_shuffle(spark):
    plan = plan_of(QUERIES["a1_counts_in_one_pass"](spark, SF)).split("Initial Plan")[-1]
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Expand" in plan


def test_selectors_scan_each_table_twice(spark):
    plan = plan_of(QUERIES["f9_device_selector"](spark, SF)).split("Initial Plan")[-1]
    assert plan.count("FileScan") <= 12


def test_selectors_broadcast_nothing(spark):
    """Exploded keys are many more rows than the estimate knows of."""
    plan = plan_of(QUERIES["f9_device_selector"](spark, SF)).split("Initial Plan")[-1]
    assert "Broadcast" not in plan and plan.count("ShuffledHashJoin") == 1
