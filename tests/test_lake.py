"""The question interface with its defaults."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from fleetlake.operators.filters import QueryWindow
from fleetlake.operators import ledgers
from fleetlake.plans import inputs
from fleetlake.plans.inputs import reported_archive
from fleetlake.plans.catalog_fleet import accepted
from fleetlake.plans.lake import Lake


@pytest.fixture(scope="module")
def lake(spark):
    return Lake(
        inputs.AS_OF, inputs.index(spark, SF), inputs.states(spark, SF), reported_archive(spark, SF), inputs.inventory(spark, SF),
        ledgers.stored_snapshots(accepted(spark, SF)), inputs.configuration(spark, SF))


def test_device_questions(lake):
    newest = lake.timeline({"hours": "168", "limit": "3"}, "7").collect()
    assert len(newest) == 3 and newest[0].event_time > newest[1].event_time > newest[2].event_time
    assert lake.health({"hours": "168"}, "7").first().event_count > 3
    assert lake.health({"hours": "168", "limit": "2"}, "7").first().event_count == 2
    assert lake.summary({"hours": "720"}, "7").first().device_id == "7"
    assert lake.anomalies({"hours": "168", "severity": "high"}).filter("severity <> 'high'").count() == 0
    assert lake.anomalies({"hours": "1"}, "no such device").count() == 0
    assert sum(r.n for r in lake.type_counts({"hours": "720", "limit": "5"}, "7").collect()) == 5


def test_fleet_questions(lake):
    total = lake.states.count()
    assert sum(r.device_count for r in lake.fleet_summary().collect()) == total
    risky = lake.fleet_anomalies(hours=720).collect()
    order = {"critical": 4, "warning": 3, "unknown": 2, "healthy": 1}
    assert [order[r.health_status] for r in risky] == sorted((order[r.health_status] for r in risky), reverse=True)
    offline = [r.last_event_time for r in lake.fleet_offline(threshold_hours=1).collect()]
    assert offline == sorted(offline) and offline
    assert lake.fleet_anomalies(hours=720, limit=2).collect() == risky[:2]


def test_no_limit_unless_asked(spark, lake):
    """More than 100 devices of one project, and more than 1,000 events of one device."""
    from dataclasses import replace

    many = lake.states.crossJoin(spark.range(30)).withColumns({"project_id": F.lit("one"), "device_id": F.concat_ws("-", "device_id", F.col("id").cast("string"))}).drop("id")
    large = replace(lake, states=many)
    assert [r.device_count for r in large.fleet_summary().collect()] == [many.count()] and many.count() > 100
    events = lake.index.filter("device_id = '7'").limit(1).crossJoin(spark.range(1500)).withColumn("event_time", F.to_timestamp(F.lit("2024-01-30")) + F.make_dt_interval(secs=F.col("id"))).withColumn("event_date", F.to_date("event_time")).drop("id")
    assert replace(lake, index=events).health({"hours": "168"}, "7").first().event_count == 1500


def test_fleet_questions_fold_no_arrivals(spark):
    from fleetlake.plans import registry

    for name in ("q5_fleet_summary", "q6_fleet_anomalies", "q7_fleet_offline", "q11_fleet_report", "q13_device_list", "r8_attention", "r9_reporting_expectation", "a9_fleet_counters", "a10_coverage", "a11_firmware_distribution", "a12_charge_overview", "l3_fleet_risk_top", "l4_offline_top", "l5_recent_activity", "j2_inventory_join"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "payload_digest" not in plan and "serial_log_line" not in plan.replace("last_serial_log_line", ""), name


def test_serial_and_report(lake):
    window = QueryWindow.since("700h", lake.as_of, limit=50)
    assert {r.kind for r in lake.serial(window, include_collector=True).collect()} == {"SERIAL", "COLLECTOR"}
    assert QueryWindow.starting("2024-01-01", lake.as_of, "2024-01-02").end < window.end
    blocks = lake.report("p")
    assert blocks["coverage"].first().inventory == blocks["devices"].count()
    blocks["devices"].unpersist()


def test_narrow_slices_are_cut_anew(spark, lake):
    from dataclasses import replace

    from fleetlake.operators.ordered import plan_slices

    sliced = replace(lake, slices=plan_slices(lake.index, ["device_id"], "event_time", 4))
    assert sorted(map(str, sliced.timeline_analytics().collect())) == sorted(map(str, lake.timeline_analytics().collect()))
