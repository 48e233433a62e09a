"""Normalization of single webhook bodies."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlake.functions.payload import analytics_payload, ingest_payload, json_type
from fleetlake.functions.values import fixed_text, number_text, prefix_number, whole_number
from fleetlake.operators import normalize as N
from fleetlake.sources import webhook

AT = datetime(2026, 6, 28, 10, 0, 1)


def bodies(spark, *items):
    rows = [(i if i is None or isinstance(i, str) else json.dumps(i), AT) for i in items]
    return spark.createDataFrame(rows, webhook.LANDING_SCHEMA)


def normalized(spark, *items):
    return N.normalize(webhook.accepted(webhook.parse_bodies(bodies(spark, *items)))).collect()


def one(spark, **body):
    return normalized(spark, body)[0]


def test_bodies_are_accepted_or_quarantined(spark):
    parsed = webhook.parse_bodies(bodies(spark, {"event": "a"}, '{"event":', "", None, "[1]", '{"a":1} x', "{'a':1}"))
    assert [r.status for r in parsed.collect()] == ["accepted", "invalid", "accepted", "missing", "invalid", "invalid", "invalid"]
    assert webhook.quarantined(parsed).count() == 5


def test_identity_fallbacks(spark):
    r = one(spark, event="e", coreid="c", deviceId="d", published_at="2026-06-28T10:00:00.000Z", timestamp="2020-01-01T00:00:00Z")
    assert (r.device_id, r.event_time_text, r.is_synthetic_time) == ("c", "2026-06-28T10:00:00.000Z", False)
    r = one(spark, coreid="", deviceId="d", published_at="", timestamp="2026-06-28T09:00:00.000Z")
    assert (r.device_id, r.event_name, r.event_time_text) == ("d", "unknown", "2026-06-28T09:00:00.000Z")
    r = one(spark)
    assert (r.device_id, r.event_time_text, r.is_synthetic_time) == ("unknown", "2026-06-28T10:00:01.000Z", True)


def test_archive_key_and_stable_id(spark):
    r = one(spark, event="hook", coreid="c", published_at="2026-06-28T10:00:00.123Z")
    assert r.archive_key == "events/2026-06-28/hook/c/2026-06-28T10-00-00-123Z.json"
    assert r.event_id == one(spark, event="hook", coreid="c", published_at="2026-06-28T10:00:00.123Z", data="x").event_id
    assert len(r.event_id) == 64 and r.raw_ref.s3_key == r.archive_key


def test_entity_payload_without_opening_brace(spark):
    r = one(spark, event="sensor", data="&quot;battery&quot;:90.7,&quot;temp&quot;:29.7,&quot;connecttime&quot;:12,&quot;resets&quot;:3,&quot;alerts&quot;:0}")
    assert (r.battery, r.temperature, r.connect_time, r.reset_count, r.alert_count) == (90.7, 29.7, 12, 3, 0)
    assert (r.plane, r.event_type) == ("telemetry", "telemetry.health")


def test_object_payload_and_case_insensitive_fields(spark):
    r = one(spark, event="sensor", data={"Battery": "85.5", "OCCUPANCY": 4, "dailyOccupancy": 40, "Temperature": 21})
    assert (r.battery, r.occupancy, r.daily_occupancy, r.temperature, r.event_type, r.data_type) == (85.5, 4, 40, 21, "telemetry.occupancy", "object")


def test_null_payload_key_blocks_the_body(spark):
    assert one(spark, battery=50, data={"battery": None}).battery is None
    assert one(spark, battery=50, data={"x": 1}).battery == 50


def test_bad_numbers_are_skipped(spark):
    r = one(spark, data={"battery": "abc", "resets": "", "alerts": "1e400", "temp": " 5 "})
    assert (r.battery, r.reset_count, r.alert_count, r.temperature) == (None, None, None, 5)


def test_malformed_payload_is_a_plain_event(spark):
    r = one(spark, event="sensor", data='{"battery": 5')
    assert (r.battery, r.event_type, r.data_type) == (None, "telemetry.event", "string")


def test_firmware_from_payload_then_envelope(spark):
    assert one(spark, fw_version="1", data={"fw_version": "2"}).fw_version == "2"
    assert one(spark, fw_version="1").fw_version == "1"
    assert one(spark, fw_version="1", data={"fw_version": 47}).fw_version == "47"


@pytest.mark.parametrize("name,plane,kind", [
    ("app-watchdog", "forensic", "fault.watchdog"), ("Status", "forensic", "telemetry.status"), ("boot", "forensic", "telemetry.event"),
    ("device-fault", "forensic", "telemetry.event"), ("hook", "telemetry", "telemetry.event"), ("serialLog", "serial", "serial.event"),
])
def test_classes(spark, name, plane, kind):
    r = one(spark, event=name, eventType="OTHER" if name == "serialLog" else None)
    assert (r.plane, r.event_type) == (plane, kind)


@pytest.mark.parametrize("source,kind,state", [
    ("SERIAL_CONNECTED", "serial.lifecycle.connected", "connected"), ("serial_disconnected", "serial.lifecycle.disconnected", "disconnected"),
    ("SERIAL_MISSING", "serial.lifecycle.missing", "missing"),
])
def test_lifecycle(spark, source, kind, state):
    r = one(spark, event="x", sourceType="serial-forwarder", eventType=source)
    assert (r.event_type, r.network_state, r.source_type) == (kind, state, "serial-forwarder")


@pytest.mark.parametrize("line,severity,category,state,flags,depth", [
    ("0001 [app] ERROR: modem timeout", "ERROR", "modem", None, (False, False, False), None),
    ("warn cloud disconnected", "WARN", "network", "disconnected", (False, False, False), None),
    ("INFO reconnect attempt", "INFO", "network", "reconnecting", (True, False, False), None),
    ("vbat low", None, "power", None, (False, False, False), None),
    ("watchdog pet", None, "watchdog", None, (False, True, False), None),
    ("publishQueue depth: 12", None, "queue", None, (False, False, False), 12),
    ("panic! rebooting", None, "reset", None, (False, False, True), None),
    ("hello", None, "other", None, (False, False, False), None),
])
def test_serial_lines(spark, line, severity, category, state, flags, depth):
    r = one(spark, event="serialLog", eventType="LOG", logLine=line)
    assert (r.severity, r.serial_category, r.network_state, r.queue_depth) == (severity, category, state, depth)
    assert (r.reconnect_detected, r.watchdog_detected, r.reset_detected) == flags
    assert (r.event_type, r.serial_log_line) == ("serial.log", line)


def test_serial_line_from_data_and_truncation(spark):
    assert one(spark, event="serialLog", eventType="LOG", data="TRACE x").severity == "TRACE"
    assert len(one(spark, event="serialLog", logLine="y" * 900).serial_log_line) == 500


def test_non_serial_events_have_no_serial_fields(spark):
    r = one(spark, event="hook", logLine="ERROR modem")
    assert (r.severity, r.serial_category, r.watchdog_detected, r.serial_log_line) == (None, None, None, None)


def column(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("o", build(F.col("t")))
    return [r.o for r in df.orderBy("i").collect()]


def test_payload_rules_differ(spark):
    texts = ['{"a":1}', '{"a":1} x', '"a":1}', '"a":1', "[1,2]", "5", "text", "", "{'a':1}", '{"a":&quot;b&quot;}', '{"a":NaN}']
    ingest = column(spark, texts, lambda t: ingest_payload(t, F.lit(True)))
    assert ingest == [{"a": "1"}, None, {"a": "1"}, {"a": "1"}, None, None, None, {}, None, {"a": "b"}, None]
    analytics = column(spark, texts, analytics_payload)
    assert analytics == [{"a": "1"}, None, {"a": "1"}, {"a": "1"}, {}, None, None, {}, None, {"a": "b"}, None]


def test_types_and_numbers(spark):
    assert column(spark, ['{"a":1}', "[1]", "null", "5", "true", '"s"', "plain", "-", None, "{bad"], json_type) == [
        "object", "object", "object", "number", "boolean", "string", "string", "string", "undefined", "string"]
    assert column(spark, ["5", " 5 ", "", " ", "1e3", "5x", "Infinity", "0x10", ".5", "5d"], whole_number) == [5, 5, None, 0, 1000, None, None, None, 0.5, None]
    assert column(spark, ["5x", " -2.5e1abc", "x5", "", "7"], prefix_number) == [5, -25, None, None, 7]
    numbers = spark.range(1).select(
        number_text(F.lit(200.0)), number_text(F.lit(181.5)), number_text(F.lit(0.0)), fixed_text(F.lit(62.5), 0), fixed_text(F.lit(19.0), 1)
    ).first()
    assert tuple(numbers) == ("200", "181.5", "0", "63", "19.0")


def test_last_received_wins(spark):
    rows = spark.createDataFrame(
        [("d", text, datetime(2026, 1, 1, 0, 0, s), e) for text, s, e in (
            ("2026-01-01T00:00:00Z", 1, "x"), ("2026-01-01T00:00:00Z", 9, "y"), ("2026-01-01T00:00:00Z", 5, "z"),
            ("2026-01-01T01:00:00+01:00", 2, "same instant"), ("no time", 3, "a"), ("no time 2", 4, "b"))],
        "device_id string, event_time_text string, received_at timestamp, event_id string")
    dated = rows.withColumn("event_time", F.col("event_time_text").try_cast("timestamp"))
    assert sorted(r.event_id for r in N.event_index(dated).collect()) == ["a", "b", "same instant", "y"]
