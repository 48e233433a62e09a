"""Schedule, configuration, presentation, selectors, parameters and fleet report rows."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetlake.functions.values import age_text
from fleetlake.operators import filters, fleet, ledgers, schedule
from fleetlake.operators.presentation import friendly, normalized_severity, present, serial_log
from fleetlake.plans import device
from fleetlake.plans.fleet import fleet_report
from fleetlake.sources.inventory import explode_pages

POSIX = "EST5EDT,M3.2.0/2:00:00,M11.1.0/2:00:00"
NY = "America/New_York"


def t(text):
    return datetime.fromisoformat(text) if text else None


@pytest.mark.parametrize("last,interval,opens,closes,zone,expected", [
    ("2026-07-14T10:00", 3600, 6, 22, NY, "2026-07-14T11:00"),
    ("2026-07-15T01:00", 3600, 6, 22, NY, "2026-07-15T02:00"),  # exactly at closing
    ("2026-07-15T02:00", 3600, 6, 22, NY, "2026-07-15T10:00"),
    ("2026-07-15T00:13", 7200, 6, 22, NY, "2026-07-15T10:00"),
    ("2026-07-15T02:00", 3600, 6, 22, POSIX, "2026-07-15T10:00"),
    ("2026-01-15T04:00", 3600, 6, 22, POSIX, "2026-01-15T11:00"),  # standard time
    ("2026-07-15T12:00", 3600, 22, 6, NY, "2026-07-16T02:00"),  # overnight, closed at noon
    ("2026-07-15T03:00", 3600, 22, 6, NY, "2026-07-15T04:00"),  # overnight, open at midnight
    ("2026-07-15T02:00", 3600, 8, 8, NY, "2026-07-15T03:00"),  # equal hours are always open
    ("2026-07-15T02:00", 3600, None, 22, NY, "2026-07-15T03:00"),  # incomplete hours
    ("2026-07-15T02:00", 3600, 6, 22, " ", "2026-07-15T03:00"),  # no zone
    ("2026-07-15T02:00", 3600, 6, 22, "Mars/Base", None),
    ("2026-07-15T02:00", 0, 6, 22, NY, None),
    ("2026-03-08T05:30", 3600, 2, 22, NY, "2026-03-08T07:00"),  # opening falls into the spring gap
    ("2026-03-08T05:30", 3600, 2, 22, POSIX, "2026-03-08T07:00"),
    ("2026-11-01T03:30", 3600, 1, 22, NY, "2026-11-01T05:00"),  # opening occurs twice in autumn
    ("2026-11-01T03:30", 3600, 1, 22, POSIX, "2026-11-01T05:00"),
    ("2026-07-15T02:00", 3600, 6, 22, "america/new_york", "2026-07-15T10:00"),
    ("2026-07-15T02:00", 3600, 6, 22, "UTC0", "2026-07-15T06:00"),  # POSIX zone without daylight time
    ("2026-01-15T14:00", 3600, 6, 22, "<+0530>-5:30", "2026-01-15T15:00"),
    ("2026-01-15T12:00", 3600, 6, 22, "AEST-10AEDT,M10.1.0,M4.1.0/3", "2026-01-15T19:00"),  # southern summer
    ("2026-07-15T02:00", 3600, 6, 22, "EST5EDT,M13.2.0,M11.1.0", None),  # rule out of range
])
def test_next_report(spark, last, interval, opens, closes, zone, expected):
    row = spark.createDataFrame([(t(last), interval, opens, closes, zone)], "l timestamp, i int, o int, c int, z string")
    assert schedule.next_report(row, "l", "i", "o", "c", "z").first().next_scheduled_report == t(expected)


def test_posix_transitions(spark):
    zones = schedule.zone_rules(spark.createDataFrame([(POSIX,), ("UTC0",), (NY,)], "z string"), "z")
    rows = schedule.posix_transitions(zones, 2024, 2026).orderBy("year").collect()
    assert [(r.year, r.daylight_start, r.daylight_end) for r in rows] == [
        (2024, t("2024-03-10T07:00"), t("2024-11-03T06:00")), (2025, t("2025-03-09T07:00"), t("2025-11-02T06:00")),
        (2026, t("2026-03-08T07:00"), t("2026-11-01T06:00")),
    ]


def configured(spark, defaults, settings):
    row = spark.createDataFrame([(defaults if defaults is None else json.dumps(defaults), settings if settings is None else json.dumps(settings))],
                                "product_defaults string, device_settings string")
    r = fleet.with_configuration(row).first()
    return r.reporting_interval_seconds, r.connection_budget_seconds, r.open_hour, r.close_hour, r.time_zone


def test_configuration_overlay(spark):
    defaults = {"timing": {"reportingIntervalSec": 3600, "connectAttemptBudgetSec": 600, "openHour": 6, "closeHour": 22, "timezone": NY}}
    assert configured(spark, defaults, None) == (3600, 600, 6, 22, NY)
    assert configured(spark, defaults, {"timing": {"reportingIntervalSec": 60}}) == (60, 600, 6, 22, NY)
    assert configured(spark, defaults, {"timing": {"openHour": None, "timezone": "UTC"}}) == (3600, 600, None, 22, "UTC")
    assert configured(spark, defaults, {"timing": 5}) == (None, None, None, None, None)
    assert configured(spark, defaults, {"timing": {"reportingIntervalSec": "60"}, "reporting": {"intervalMinutes": 2}}) == (120, 600, 6, 22, NY)
    assert configured(spark, {"timing": {"openHour": 24, "closeHour": 5.5}, "connection": {"budgetSeconds": 9}}, {}) == (None, 9, None, None, None)
    assert configured(spark, None, None) == (None,) * 5


INDEX = "event_type string, event_name string, source_type string, source_event_type string, severity string, serial_log_line string, log_line string, battery double, occupancy double"


@pytest.mark.parametrize("event,kind,summary", [
    ({"event_type": "serial.log", "serial_log_line": " boot ok "}, "SERIAL", "boot ok"),
    ({"event_type": "serial.log", "log_line": "/dev/serial/by-id/usb-1 up"}, "COLLECTOR", "Serial device connected: /dev/serial/by-id/usb-1 up"),
    ({"event_type": "serial.log"}, "SERIAL", "Serial log event"),
    ({"event_type": "serial.lifecycle.missing"}, "COLLECTOR", "Serial device missing"),
    ({"event_type": "collector.restart_done"}, "COLLECTOR", "Collector Restart Done"),
    ({"event_type": "serial.event"}, "COLLECTOR", "Serial Forwarder event"),
    ({"event_type": "telemetry.status", "event_name": "status"}, "LIFECYCLE", "Device status event"),
    ({"event_type": "telemetry.status"}, "LIFECYCLE", "Device status event"),
    ({"event_type": "telemetry.status", "event_name": "device-status"}, "TELEMETRY", "Telemetry Status"),
    ({"event_type": "fault.watchdog"}, "WATCHDOG", "Fault Watchdog"),
    ({"event_name": "app-watchdog", "log_line": "reset"}, "WATCHDOG", "reset"),
    ({"event_type": "telemetry.health", "battery": 80.5, "occupancy": 3.0}, "TELEMETRY", "occupancy=3 battery=80.5"),
    ({"event_type": "telemetry.occupancy"}, "TELEMETRY", "Occupancy report"),
    ({"battery": 7.0}, "TELEMETRY", "battery=7"),
    ({"event_name": "crash_log", "severity": "fatal"}, "ERROR", "Crash Log"),
    ({"source_event_type": "serial_connected"}, "COLLECTOR", "Serial Forwarder event"),
    ({"event_name": "serialLog", "log_line": "old"}, "SERIAL", "old"),
    ({"source_type": "serial-forwarder"}, "COLLECTOR", "Serial Forwarder event"),
    ({"event_name": "hello.world"}, "EVENT", "Hello World"),
    ({}, "EVENT", "Event"),
])
def test_presentation(spark, event, kind, summary):
    names = [f.split()[0] for f in INDEX.split(", ")]
    r = present(spark.createDataFrame([tuple(event.get(n) for n in names)], INDEX)).first()
    assert (r.kind, r.summary) == (kind, summary)


def test_titles_and_severities(spark):
    r = spark.range(1).select(friendly(F.lit("a.bC-d_e/f"), F.lit(None).cast("string"), "x"), normalized_severity(F.lit(" warn ")), normalized_severity(F.lit("odd"))).first()
    assert tuple(r) == ("A BC D E/F", "warning", None)


def test_serial_log_limit_and_text(spark):
    rows = [("d", datetime(2026, 1, 1, 0, i), f"e{i}", "serial.log" if i != 2 else "serial.lifecycle.missing", f"line {i}" if i != 2 else None) for i in range(5)]
    df = spark.createDataFrame(rows, "device_id string, event_time timestamp, event_id string, event_type string, serial_log_line string")
    assert [r.summary for r in serial_log(df, limit=2).orderBy("event_time").collect()] == ["line 0", "line 1"]
    assert serial_log(df, include_collector=True).count() == 5
    assert [r.summary for r in serial_log(df, contains="3").collect()] == ["line 3"]


def test_ages(spark):
    now = datetime(2026, 1, 10)
    cases = [(30, "30 sec"), (90, "1 min"), (7200, "2 hr"), (47 * 3600, "47 hr"), (48 * 3600, "2 days"), (-5, "0 sec")]
    df = spark.createDataFrame([(now - timedelta(seconds=s), now) for s, _ in cases], "a timestamp, n timestamp")
    assert sorted(r[0] for r in df.select(age_text(F.col("a"), F.col("n"))).collect()) == sorted(x for _, x in cases)
    assert df.select(age_text(F.col("a"), F.col("n"), long=True)).collect()[1][0] == "1 minutes"


AS_OF = "2026-07-15T12:00:00Z"


def test_window_parameters():
    parse = filters.QueryWindow.parse
    end = datetime(2026, 7, 15, 12, tzinfo=timezone.utc)
    w = parse({}, AS_OF)
    assert (w.start, w.end, w.limit, w.severity) == (end - timedelta(hours=24), end, 100, None)
    assert parse({"hours": "1.5", "limit": "50x", "severity": "HIGH"}, AS_OF) == filters.QueryWindow(end - timedelta(hours=1.5), end, 50, "high")
    assert parse({"start": "2026-07-01T00:00:00Z", "end": "2026-07-02T02:00:00+02:00", "hours": "5"}, AS_OF).end == datetime(2026, 7, 2, tzinfo=timezone.utc)
    for bad in ({"hours": "0"}, {"hours": "169"}, {"hours": "x"}, {"limit": "0"}, {"limit": "1001"}, {"limit": "x"}, {"severity": "bad"},
                {"start": "2026-07-02", "end": "2026-07-01"}, {"start": "2026-07-01", "end": "2026-07-16"}, {"start": "no", "end": "2026-07-01"}):
        with pytest.raises(ValueError):
            parse(bad, AS_OF)
    assert filters.parse_duration("1.5h") == timedelta(minutes=90) and filters.parse_duration("30") == timedelta(seconds=30)
    with pytest.raises(ValueError):
        filters.parse_duration("5 days")
    with pytest.raises(ValueError):
        filters.health_status("dead")


def test_selectors(spark):
    full = "a" * 24
    devices = spark.createDataFrame([(full, "Lobby North"), ("d2", "Lobby South"), ("d3", "Roof"), ("d4", "roof ")], "device_id string, device_name string")
    asked = spark.createDataFrame([(s,) for s in (full, "b" * 24, "lobby north", "SOUTH", "lobby", "roof", "zz", "of")], "selector string")
    got = {r.selector: (r.device_id, r.matches, r.match) for r in filters.select_devices(devices, asked).collect()}
    assert got == {
        full: (full, 1, "id"), "b" * 24: (None, 0, "none"), "lobby north": (full, 1, "exact"), "SOUTH": ("d2", 1, "partial"),
        "lobby": (None, 2, "ambiguous"), "roof": (None, 2, "ambiguous"), "zz": (None, 0, "none"), "of": (None, 2, "ambiguous"),
    }


def fetch(spark, *rows):
    """(ledger, status, body, minute) rows of one device."""
    at = datetime(2026, 1, 1)
    return spark.createDataFrame(
        [(ledger, "9", "d", code, body if body is None or isinstance(body, str) else json.dumps(body), at + timedelta(minutes=m), i) for i, (ledger, code, body, m) in enumerate(rows)],
        "ledger_name string, product_id string, scope_value string, http_status int, body string, fetched_at timestamp, seq bigint")


def snapshot(updated, **data):
    return {"instance": {"data": data, "updated_at": updated, "size_bytes": 10}}


def test_fetch_outcomes(spark):
    s = "device-status"
    rows = fetch(spark, (s, 200, snapshot("2026-01-01T00:00:00Z", a=1), 0), (s, 401, None, 1), (s, 403, None, 2), (s, 404, None, 3), (s, 429, None, 4), (s, 504, None, 5),
                 (s, 418, None, 6), (s, None, None, 7), (s, 200, "", 8), (s, 200, "{bad", 9), (s, 200, {"instance": {}}, 10), (s, 200, {"instance": {"data": [1]}}, 11), (s, 200, "[]", 12))
    got = [(r.outcome, r.retryable) for r in ledgers.classify_fetches(rows).orderBy("seq").collect()]
    assert got == [("ok", False), ("auth_failure", False), ("auth_failure", False), ("missing_ledger", False), ("retryable_failure", True), ("retryable_failure", True),
                   ("permanent_failure", False), ("network_failure", True), ("malformed_json", False), ("malformed_json", False), ("permanent_failure", False),
                   ("permanent_failure", False), ("permanent_failure", False)]


def test_newest_snapshot_wins_and_missing_settings_clear(spark):
    s = "device-settings"
    rows = ledgers.classify_fetches(fetch(
        spark, (s, 200, snapshot("2026-01-05T00:00:00Z"), 0), (s, 200, snapshot("2026-01-05T00:00:00Z"), 1), (s, 200, snapshot("2026-01-04T00:00:00Z"), 2),
        (s, 404, None, 3), (s, 200, snapshot("2026-01-01T00:00:00Z"), 4), (s, 200, {"instance": {"data": {}}}, 5)))
    done = ledgers.accept(rows)
    assert [r.effect for r in done.orderBy("seq").collect()] == ["updated", "stale", "stale", "cleared", "updated", "missing_updated_at"]
    assert ledgers.stored_snapshots(done).first().updated_at == t("2026-01-01T00:00")
    # Continuing from the stored snapshot gives the same effects.
    early, late = rows.filter("seq < 2"), rows.filter("seq >= 2")
    saved = ledgers.stored_snapshots(ledgers.accept(early))
    assert [r.effect for r in ledgers.accept(late, stored=saved).orderBy("seq").collect()] == ["stale", "cleared", "updated", "missing_updated_at"]


def test_reset_projection(spark):
    s = "device-status"
    rows = ledgers.accept(ledgers.classify_fetches(fetch(
        spark, (s, 200, snapshot("2026-01-01T00:00:00Z", schemaVersion=2, firmware={"resetCount": 4}, startup={"resetCount": " 7 "}), 0),
        (s, 200, snapshot("2026-01-02T00:00:00Z", schemaVersion="2", firmware={"resetCount": 5}), 1),
        (s, 200, snapshot("2026-01-03T00:00:00Z", schemaVersion=1, firmware={"resetCount": 99}), 2),
        (s, 200, snapshot("2026-01-04T00:00:00Z", schemaVersion=2, firmware={"resetCount": "x"}), 3))))
    r = ledgers.reset_projection(rows).first()
    assert (r.firmware_reset_count, r.startup_reset_count) == (5, 7)


def test_inventory_pages(spark):
    pages = spark.createDataFrame([('[{"id":"a","name":" A "}]',), ('{"devices":[{"device_id":"b","product_id":7}]}',), ('{"data":[{"deviceId":"c"},{"name":"no id"}]}',), ("{}",)], "page string")
    rows = fleet.normalize_inventory(explode_pages(pages), "p").orderBy("device_id").collect()
    assert [(r.device_id, r.inventory_name, r.inventory_product_id) for r in rows] == [("a", "A", "p"), ("b", None, "7"), ("c", None, "p")]


def test_fleet_report_blocks(spark):
    from conftest import SF
    from fleetlake.plans import inputs
    from fleetlake.plans.catalog_fleet import PRODUCT, accepted

    blocks = fleet_report(
        inputs.inventory(spark, SF), inputs.states(spark, SF), ledgers.stored_snapshots(accepted(spark, SF)), inputs.configuration(spark, SF), PRODUCT, inputs.AS_OF)
    devices = blocks["devices"].count()
    c = blocks["coverage"].first()
    assert c.inventory == devices == c.connected + c.disconnected + c.unknown
    assert sum(r["count"] for r in blocks["firmware"].collect()) == devices
    assert blocks["charge"].first().observed + blocks["charge"].first().unknown == devices
    assert blocks["activity"].count() == fleet.ACTIVITY_LIMIT
    assert blocks["attention"].select("device_id").distinct().count() <= devices
    blocks["devices"].unpersist()


def test_one_device_timeline(spark):
    from conftest import SF
    from fleetlake.plans import inputs

    window = filters.QueryWindow.parse({"hours": "720", "limit": "4"}, inputs.AS_OF, max_hours=720)
    rows = device.timeline(inputs.index(spark, SF), window, "7").collect()
    assert len(rows) == 4 and {r.device_id for r in rows} == {"7"}
