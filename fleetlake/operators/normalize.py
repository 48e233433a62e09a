"""Raw webhook events to typed, classified event rows: one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetlake.functions.payload import field_ignoring_case, has_key, ingest_payload, json_type, lower_keys
from fleetlake.functions.values import empty_to_null, iso, whole_number
from fleetlake.operators.ordered import newest

# Metric column and the payload fields it is read from, first present wins.
METRICS = {
    "battery": ["battery"],
    "connect_time": ["connecttime"],
    "reset_count": ["resets"],
    "alert_count": ["alerts"],
    "occupancy": ["occupancy"],
    "daily_occupancy": ["dailyoccupancy"],
    "temperature": ["temp", "temperature"],
}
# Payload keys that classify an event.
OCCUPANCY_KEYS = ["occupancy", "dailyoccupancy"]
HEALTH_KEYS = ["battery", "connecttime", "resets", "alerts", "temperature", "temp"]
# Serial log categories in the order they are tested.
SERIAL_CATEGORIES = [
    ("modem", "modem|ncp|cellular|sim"),
    ("network", "cloud|network|connect|reconnect|disconnect"),
    ("power", "battery|power|pmic|vbat|charge"),
    ("watchdog", "watchdog"),
    ("queue", "queue|queued|publishqueue|inflight"),
    ("reset", "reset|reboot|panic"),
]
# Lifecycle names sent by the serial collector.
LIFECYCLE = {"SERIAL_CONNECTED": "connected", "SERIAL_DISCONNECTED": "disconnected", "SERIAL_MISSING": "missing"}


@dataclass(frozen=True)
class Settings:
    """Deployment names; pass your own to keep existing keys."""

    default_project: str = "default"
    default_source: str = "cloud-webhook"
    serial_source: str = "serial-forwarder"
    archive_prefix: str = "events"
    log_line_limit: int = 500


DEFAULTS = Settings()


def identity(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Device, event name, event time with fallbacks, archive key and stable event id."""
    stamp = F.coalesce(empty_to_null(F.col("published_at")), empty_to_null(F.col("timestamp")))
    named = raw.withColumns({
        "device_id": F.coalesce(empty_to_null(F.col("coreid")), empty_to_null(F.col("deviceId")), F.lit("unknown")),
        "event_name": F.coalesce(empty_to_null(F.col("event")), F.lit("unknown")),
        "event_time_text": F.coalesce(stamp, iso(F.col("received_at"))),
        "is_synthetic_time": stamp.isNull(),
        "project_id": F.coalesce(empty_to_null(F.col("projectId")), F.lit(settings.default_project)),
    })
    keyed = named.withColumns({
        "event_time": F.col("event_time_text").try_cast("timestamp"),
        "archive_key": archive_key(
            F.col("event_name"), F.col("device_id"), F.col("event_time_text"), settings.archive_prefix
        ),
    })
    return keyed.withColumn("event_id", event_id("device_id", "event_name", "event_time_text", "archive_key"))


def archive_key(name: Column, device: Column, time_text: Column, prefix: str) -> Column:
    """Date-first path of the raw object."""
    safe_time = F.concat(F.regexp_replace(time_text, "[:.]", "-"), F.lit(".json"))
    return F.concat_ws("/", F.lit(prefix), F.substring(time_text, 1, 10), name, device, safe_time)


def event_id(*parts: str) -> Column:
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def plane(name: Column, source_type: Column, settings: Settings = DEFAULTS) -> Column:
    serial = F.coalesce(source_type == settings.serial_source, F.lit(False)) | (name == "serialLog")
    return (
        F.when(serial, "serial")
        .when(name.rlike("(?i)watchdog|status|reset|boot|fault"), "forensic")
        .otherwise("telemetry")
    )


def event_type(name: Column, plane_: Column, source_event_type: Column, log_line: Column, keys: Column) -> Column:
    source = F.upper(source_event_type)
    effective = F.coalesce(empty_to_null(source), F.upper(name))
    lower = F.lower(name)
    has_line = F.coalesce(log_line != "", F.lit(False))
    serial = F.when(effective == "LOG", "serial.log")
    for wire, state in LIFECYCLE.items():
        serial = serial.when(effective == wire, f"serial.lifecycle.{state}")
    serial = serial.when(
        (lower == "seriallog") & (empty_to_null(source).isNull() | has_line), "serial.log"
    ).otherwise("serial.event")
    return (
        F.when(plane_ == "serial", serial)
        .when(lower.contains("watchdog"), "fault.watchdog")
        .when(lower.contains("status"), "telemetry.status")
        .when(has_key(keys, OCCUPANCY_KEYS), "telemetry.occupancy")
        .when(has_key(keys, HEALTH_KEYS), "telemetry.health")
        .otherwise("telemetry.event")
    )


def serial_line(log_line: Column, data: Column, data_is_text: Column, source_event_type: Column) -> Column:
    from_data = (F.upper(source_event_type) == "LOG") & F.coalesce(data_is_text, F.lit(True))
    return F.coalesce(log_line, F.when(from_data, data))


def log_severity(line: Column) -> Column:
    return empty_to_null(F.upper(F.regexp_extract(line, r"(?i)\b(TRACE|INFO|WARN|ERROR)\b", 1)))


def serial_category(line: Column) -> Column:
    lower = F.lower(line)
    out = F.when(line.isNull() | (line == ""), F.lit(None).cast("string"))
    for name, words in SERIAL_CATEGORIES:
        out = out.when(lower.rlike(words), name)
    return out.otherwise("other")


def network_state(source_event_type: Column, line: Column) -> Column:
    source, lower = F.upper(source_event_type), F.lower(line)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for wire, state in LIFECYCLE.items():
        out = out.when(source == wire, state)
    return (
        out.when(lower.rlike("reconnect|retry"), "reconnecting")
        .when(lower.contains("disconnect"), "disconnected")
        .when(lower.contains("connect"), "connected")
    )


def queue_depth(line: Column) -> Column:
    return F.regexp_extract(line, r"(?i)(?:queue|queued|publishqueue|inflight)[^0-9]*(\d+)", 1).try_cast("double")


def normalize(raw: DataFrame, settings: Settings = DEFAULTS, kept: Sequence[str] = ()) -> DataFrame:
    """The event index row of every arrival: envelope plus normalized columns, raw text kept aside. ``kept`` names further columns that go along."""
    keyed = identity(raw, settings).withColumns({
        "payload": ingest_payload(F.col("data"), F.col("data_is_text")),
        "plane": plane(F.col("event_name"), F.col("sourceType"), settings),
        "_line": serial_line(F.col("logLine"), F.col("data"), F.col("data_is_text"), F.col("eventType")),
    }).withColumns({"_keys": lower_keys(F.col("payload")), "_body_keys": lower_keys(F.col("body_fields"))})
    is_serial = F.col("plane") == "serial"
    line, lower = F.col("_line"), F.lower(F.coalesce(F.col("_line"), F.lit("")))

    def field(name: str) -> Column:
        return field_ignoring_case(F.col("payload"), F.col("_keys"), F.col("body_fields"), F.col("_body_keys"), name)

    def when_serial(c: Column) -> Column:
        return F.when(is_serial, c)

    metrics = {m: whole_number(F.coalesce(*[field(f) for f in fields])) for m, fields in METRICS.items()}
    return keyed.select(
        "device_id", "project_id", "event_time", "event_time_text", "event_name", "received_at", "archive_key", "event_id",
        F.struct(F.col("archive_key").alias("s3_key")).alias("raw_ref"),
        F.lit("1.0").alias("schema_version"), F.lit("1.0").alias("event_version"),
        "plane",
        event_type(F.col("event_name"), F.col("plane"), F.col("eventType"), F.col("logLine"), F.col("_keys")).alias("event_type"),
        F.col("eventType").alias("source_event_type"),
        F.when(is_serial, F.lit(settings.serial_source))
        .otherwise(F.coalesce(empty_to_null(F.col("sourceType")), F.lit(settings.default_source))).alias("source_type"),
        F.col("collectorId").alias("collector_id"), "transport", "public",
        F.col("deviceName").alias("device_name"),
        F.coalesce(F.col("product_id"), F.col("productId")).alias("product_id"),
        F.col("logLine").alias("log_line"),
        json_type(F.col("data")).alias("data_type"),
        F.sha2(F.concat_ws("\u0000", *[F.coalesce(c, F.lit("")) for c in ("data", "logLine", "eventType")]), 256).alias("payload_digest"),
        "data", "payload", "body_fields",
        "is_synthetic_time",
        *[c.alias(m) for m, c in metrics.items()],
        empty_to_null(F.coalesce(field("fw_version"), F.col("fw_version"))).alias("fw_version"),
        F.col("fw_version").alias("legacy_fw_version"),
        when_serial(log_severity(line)).alias("severity"),
        when_serial(empty_to_null(F.substring(line, 1, settings.log_line_limit))).alias("serial_log_line"),
        when_serial(serial_category(line)).alias("serial_category"),
        when_serial(network_state(F.col("eventType"), line)).alias("network_state"),
        when_serial(lower.rlike("reconnect|retry")).alias("reconnect_detected"),
        when_serial(lower.contains("watchdog")).alias("watchdog_detected"),
        when_serial(lower.rlike("reset|reboot|panic")).alias("reset_detected"),
        when_serial(queue_depth(line)).alias("queue_depth"),
        *kept,
    )


INDEX_ORDER = ["event_date", "device_id", "event_time", "event_time_text"]


def event_index(arrivals: DataFrame, dealt: Sequence[str] = ()) -> DataFrame:
    """One row per (device, event time as sent), the last received wins.

    The text is the key: times that cannot be read, or that name one instant in two ways, are different events. ``dealt`` names columns
    that the key fixes, by whose ranges the rows are dealt already (``INDEX_ORDER``): rows of one key lie together and do not move again.
    """
    key = dealt or ["device_id", "event_time_text"]
    return newest(arrivals, [*key], [F.col("received_at").desc(), F.col("event_id").desc()])
