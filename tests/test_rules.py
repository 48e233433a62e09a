"""State, history, anomaly and correlation rules on small hand-made devices."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import correlate, history, rules, sequence, state

T0 = datetime(2026, 6, 28, 10, 0, 0)
ARRIVAL = (
    "project_id string, device_id string, event_id string, event_time timestamp, event_time_text string, received_at timestamp, event_name string, "
    "event_type string, plane string, source_type string, source_event_type string, device_name string, fw_version string, battery double, "
    "connect_time double, reset_count double, alert_count double, occupancy double, daily_occupancy double, temperature double, severity string, "
    "network_state string, serial_category string, serial_log_line string, log_line string, reconnect_detected boolean, watchdog_detected boolean, "
    "reset_detected boolean, payload_digest string, archive_key string"
)
FIELDS = [f.strip().split(" ")[0] for f in ARRIVAL.split(",")]


def arrivals(spark, *events):
    """Events of one device, one minute apart unless ``at`` (minutes) says otherwise; ``late`` delays the arrival."""
    rows = []
    for i, e in enumerate(events):
        at = T0 + timedelta(minutes=e.get("at", i))
        row = {
            "project_id": "p", "device_id": "d", "event_id": f"e{i:03d}", "event_time": at, "event_time_text": at.isoformat() + "Z",
            "received_at": T0 + timedelta(minutes=e.get("arrives", e.get("at", i)), seconds=1), "event_name": "hook", "event_type": "telemetry.health",
            "plane": "telemetry", "source_type": "cloud-webhook", "archive_key": f"k{i:03d}",
        }
        row |= {k: v for k, v in e.items() if k not in ("at", "arrives")}
        rows.append(tuple(row.get(f) for f in FIELDS))
    return spark.createDataFrame(rows, ARRIVAL)


def log(line="x", severity=None, **more):
    flags = {"reconnect_detected": False, "watchdog_detected": False, "reset_detected": False}
    return {"plane": "serial", "event_type": "serial.log", "event_name": "serialLog", "severity": severity, "serial_log_line": line, "log_line": line,
            "source_type": "serial-forwarder", "serial_category": "other", **flags, **more}


def final(spark, *events):
    return state.current_state(arrivals(spark, *events)).first()


def test_metrics_are_kept_and_names_stick(spark):
    s = final(spark, {"battery": 80.0, "device_name": "first"}, {"connect_time": 5.0, "device_name": "second", "fw_version": "1"}, {"occupancy": 2.0})
    assert (s.battery, s.connect_time, s.occupancy, s.device_name, s.fw_version) == (80, 5, 2, "first", "1")


def test_severity_is_kept_for_storage_but_not_for_health(spark):
    s = final(spark, {"battery": 80.0}, log(severity="ERROR"), {"battery": 79.0})
    assert (s.severity, s.health_status, s.anomaly_count, s.recent_serial_error_count) == ("ERROR", "healthy", 0, 1)


def test_silent_serial_event_keeps_health(spark):
    assert final(spark, {"battery": 10.0}, log()).health_status == "critical"
    assert final(spark, log()).health_status == "unknown"
    assert final(spark, {"battery": 80.0}, log(severity="WARN"), log()).health_status == "warning"


def test_serial_category_may_return_to_null(spark):
    s = final(spark, log(serial_category="modem"), log(serial_category=None, event_type="serial.lifecycle.connected", serial_log_line=None))
    assert s.serial_category is None and s.last_serial_log_line == "x"
    assert final(spark, log(serial_category="modem"), {"battery": 1.0}).serial_category == "modem"


def test_arrival_order_decides(spark):
    s = final(spark, {"battery": 50.0, "at": 10}, {"battery": 60.0, "at": 5, "arrives": 20})
    assert s.battery == 60 and s.last_event_time == T0 + timedelta(minutes=5)


def test_last_application_report(spark):
    s = final(spark, {"battery": 50.0}, log(), {"plane": "forensic", "event_type": "telemetry.status"})
    assert s.last_application_report_at == T0


def test_offline_border_is_strict(spark):
    def at(text):
        return F.lit(text).cast("timestamp")

    row = spark.range(1).select(
        state.offline_candidate(at("2026-01-01 00:00:00"), at("2026-01-01 03:00:00")), state.offline_candidate(at("2026-01-01 00:00:00"), at("2026-01-01 03:00:01"))
    ).first()
    assert tuple(row) == (False, True)


def kinds(spark, *events, kind=None):
    rows = history.derive_history(state.state_history(arrivals(spark, *events))).orderBy("report_time", "event_type").collect()
    return [r for r in rows if kind is None or r.event_type == kind]


def test_anomaly_repeats_until_the_flag_clears(spark):
    rows = kinds(spark, log(watchdog_detected=True), {"battery": 90.0}, {"battery": 89.0}, log(), {"battery": 88.0}, kind="ANOMALY")
    assert [[a.type for a in r.anomalies] for r in rows] == [["serial_watchdog"]] * 3


def test_firmware_update_needs_two_versions(spark):
    rows = kinds(spark, {"fw_version": "1"}, {"fw_version": "1"}, {}, {"fw_version": "2"}, {"fw_version": ""}, kind="FIRMWARE_UPDATE")
    assert [(r.from_fw_version, r.to_fw_version) for r in rows] == [("1", "2")]


def test_battery_critical_is_a_transition(spark):
    rows = kinds(spark, {"battery": 25.0}, {"battery": 19.0}, {"battery": 18.0}, {"occupancy": 1.0}, {"battery": 20.0}, {"battery": 5.0}, kind="BATTERY_CRITICAL")
    assert [r.battery_level for r in rows] == [19, 5]


def test_device_recovered(spark):
    assert len(kinds(spark, {"at": 0}, {"at": 181}, kind="DEVICE_RECOVERED")) == 1
    assert not kinds(spark, {"at": 0}, {"at": 180}, kind="DEVICE_RECOVERED")
    assert not kinds(spark, {"at": 300, "arrives": 300}, {"at": 0, "arrives": 301}, kind="DEVICE_RECOVERED")
    # The report itself is older than three hours when it arrives.
    assert not kinds(spark, {"at": 0}, {"at": 200, "arrives": 500}, kind="DEVICE_RECOVERED")


def test_history_key_is_stable_and_appended_once(spark):
    rows = arrivals(spark, {"battery": 10.0}, {"battery": 9.0})
    first = history.derive_history(state.state_history(rows))
    again = history.derive_history(state.state_history(rows))
    assert history.append_new(first, again).count() == 0
    assert history.append_new(first.filter("event_type = 'ANOMALY'"), again.unionByName(again)).count() == 1
    assert first.filter(F.col("history_key").rlike("#ANOMALY#e000#[0-9a-f]{32}$")).count() == 1


def test_state_anomaly_order(spark):
    s = final(spark, {"battery": 5.0, "connect_time": 400.0, "alert_count": 2.0}, log(severity="ERROR", watchdog_detected=True, reconnect_detected=True, reset_detected=True))
    assert [a.type for a in s.anomalies] == [
        "critical_battery", "very_high_connect_time", "active_alerts", "serial_error", "serial_watchdog", "serial_reconnect", "serial_reset"]


# ---- anomalies over the index

def found(spark, *events):
    return {(r.type, r.severity): r for r in rules.device_anomalies(arrivals(spark, *events)).collect()}


def test_threshold_messages(spark):
    got = found(spark, {"battery": 19.96}, {"battery": 20.0}, {"connect_time": 300.0}, {"connect_time": 300.5}, {"alert_count": 3.0})
    assert got["critical_battery", "high"].message == "Critical battery level: 20.0%"
    assert got["low_battery", "medium"].message == "Low battery level: 20.0%"
    assert got["high_connect_time", "medium"].message == "High connection time: 300s (threshold: 180s)"
    assert got["very_high_connect_time", "high"].message == "Very high connection time: 300.5s (threshold: 300s)"
    assert got["active_alerts", "high"].message == "Active alerts detected: 3"


def test_drain_and_firmware(spark):
    got = found(spark, {"battery": 90.0, "fw_version": "1"}, {"battery": 40.0}, {"battery": 58.0, "fw_version": "2"})
    assert got["rapid_battery_drain", "medium"].message == "Rapid battery drain: 32.0% drop (36% of initial)"
    assert got["firmware_change", "low"].value_str == "1 → 2"
    assert ("rapid_battery_drain", "medium") not in found(spark, {"battery": 90.0}, {"battery": 60.0})
    assert ("rapid_battery_drain", "medium") not in found(spark, {"battery": 0.0}, {"battery": 0.0})


def test_severity_filter_and_order(spark):
    rows = rules.device_anomalies(arrivals(spark, {"battery": 10.0}, {"battery": 25.0}, {"battery": 10.0, "fw_version": "1"}, {"fw_version": "2"}))
    assert [r.severity for r in rules.by_severity_then_newest(rows).collect()] == ["high", "high", "medium", "low"]
    assert rules.at_least(rows, "MEDIUM").count() == 3
    with pytest.raises(ValueError):
        rules.at_least(rows, "severe")


def test_gaps_round_half_up(spark):
    got = sequence.gaps(arrivals(spark, {"at": 0}, {"at": 90}, {"at": 180.5}, {"at": 300}), 90).collect()
    assert [(r.duration_minutes, r.event_before) for r in got] == [(91, "hook"), (120, "hook")]


def test_window_border_belongs_to_the_window(spark):
    got = sequence.anchored_windows(arrivals(spark, {"at": 0}, {"at": 5}, {"at": 5.01}, {"at": 9}, {"at": 10.02}), 5).orderBy("event_time").collect()
    assert [(r.window_start - T0).total_seconds() for r in got] == pytest.approx([0, 0, 300.6, 300.6, 601.2])


# ---- correlation

ARCHIVE = "archive_key string, data string, fw_version string, body_fields map<string,string>, reset_cause string, details string, message string"


def correlated(spark, *events, minutes=5):
    """(rule, severity, category, message) fired, and evidence lines by rule."""
    rows = arrivals(spark, *[{k: v for k, v in e.items() if k not in ("payload", "cause")} for e in events])
    stored = [(f"k{i:03d}", e.get("payload", "{}"), None, None, e.get("cause"), None, None) for i, e in enumerate(events) if e.get("payload", "{}") is not None]
    archive = spark.createDataFrame(stored, ARCHIVE).withColumns({"received_at": F.lit("2024-01-01").cast("timestamp"), "event_name": F.lit("status")})
    members = correlate.window_members(rows, archive, minutes)
    windows = correlate.windows(members)
    fired = correlate.inferences(windows)
    lines = correlate.evidence(members, fired).orderBy("rule", "part", "event_time").collect()
    return sorted((r.rule, r.severity, r.category, r.message) for r in fired.collect()), [(r.rule, r.line) for r in lines], windows.first()


def reading(text, **more):
    return {"payload": text, **more}


WATCHDOG = {"event_name": "app-watchdog", "event_type": "fault.watchdog", "plane": "forensic"}


def lifecycle(name):
    return {"event_name": "serialLog", "event_type": "serial.lifecycle.connected", "source_event_type": name, "plane": "serial", "source_type": "serial-forwarder"}


def test_modem_connectivity(spark):
    fired, lines, _ = correlated(spark, reading('{"connecttime":75}'), log("cellular modem error -210"))
    assert fired == [(1, "WARNING", "connectivity", "Connectivity degradation detected: High connection time with modem errors")]
    assert [line for _, line in lines] == ["connecttime=75s at 2026-06-28T10:00:00.000Z", "modem: cellular modem error -210"]


def test_usb_instability(spark):
    fired, lines, _ = correlated(spark, lifecycle("SERIAL_CONNECTED"), lifecycle("SERIAL_DISCONNECTED"), lifecycle("SERIAL_CONNECTED"))
    assert fired[0][3] == "USB instability detected: 2 connect, 1 disconnect events" and len(lines) == 3


def test_network_stall_and_reboot(spark):
    fired, lines, window = correlated(spark, reading('{"connecttime":150,"resets":1}'), {**WATCHDOG, "cause": "pin"}, reading('{"resets":3}'))
    assert [(f[0], f[1], f[2]) for f in fired] == [(3, "CRITICAL", "connectivity"), (4, "CRITICAL", "stability")]
    assert (4, "reset count: 1 → 3") in lines and (3, "watchdog: pin at 2026-06-28T10:01:00.000Z") in lines
    assert (window.n_telemetry, window.n_watchdog, window.duration_minutes) == (2, 1, 2.0)


def test_power_rules(spark):
    assert [f[0] for f in correlated(spark, reading('{"battery":15,"alerts":1}'))[0]] == [5]
    assert [f[0] for f in correlated(spark, reading('{"battery":15}'))[0]] == [8]
    # Zero does not count as a low battery here.
    assert correlated(spark, reading('{"battery":0,"alerts":0}'))[0] == []


def test_reconnect_loop_and_high_connect(spark):
    assert [f[0] for f in correlated(spark, log("reconnect 1"), log("retry 2"))[0]] == [6]
    assert [f[0] for f in correlated(spark, reading('{"connecttime":200}'))[0]] == [7]
    assert [f[0] for f in correlated(spark, reading('{"connecttime":200}'), log("reconnect"), log("retry"))[0]] == [6]


def test_missing_payload_drops_the_reading(spark):
    fired, _, window = correlated(spark, reading(None, connect_time=500.0), log("x"))
    assert fired == [] and (window.n_telemetry, window.event_count) == (0, 2)


def test_payload_findings(spark):
    rows = arrivals(spark, {"battery": 90.0, "reset_count": 1.0, "connect_time": 200.0}, {"battery": 15.0, "reset_count": 6.0, "connect_time": 190.0, "alert_count": 1.0}, {"alert_count": 0.0})
    none = rules.firmware_changes(rows)
    got = {(r.severity, r.message) for r in rules.payload_anomalies(rows, none).collect()}
    assert got == {
        ("HIGH", "Battery critically low: 15.0%"), ("MEDIUM", "Rapid battery drain: 75.0% drop (83% of initial)"),
        ("MEDIUM", "High connection time: 190s (threshold: 180s)"), ("LOW", "2 event(s) with connection time > 180s (max: 200s)"),
        ("HIGH", "Reset count increased by 5 (from 1 to 6)"), ("MEDIUM", "Active alerts detected: 1 event(s) with alerts > 0 (latest: 0)"),
    }
