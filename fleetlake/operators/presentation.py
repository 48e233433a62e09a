"""Display records: kind, summary text and normalized severity of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlake.functions.values import blank_to_null, number_text
from fleetlake.operators.ordered import newest

# Display name and column of the metrics, in display order.
METRIC_LABELS = [
    ("occupancy", "occupancy"), ("dailyOccupancy", "daily_occupancy"), ("battery", "battery"), ("temperature", "temperature"),
    ("connectTime", "connect_time"), ("resetCount", "reset_count"), ("alertCount", "alert_count"),
]
# Collector event types with their own text.
COLLECTOR_TEXT = {
    "serial.lifecycle.connected": "Serial device connected",
    "serial.lifecycle.disconnected": "Serial device disconnected",
    "serial.lifecycle.missing": "Serial device missing",
}
DEVICE_PATH = r"^/dev/serial/by-id/\S+"


def normalized_severity(severity: Column) -> Column:
    s = F.upper(F.trim(severity))
    return (
        F.when(s.isin("TRACE", "DEBUG"), "debug").when(s == "INFO", "info").when(s.isin("WARN", "WARNING"), "warning")
        .when(s == "ERROR", "error").when(s.isin("CRITICAL", "FATAL"), "critical")
    )


def friendly(event_type: Column, event_name: Column, fallback: str) -> Column:
    """Type or name with separators as blanks and the first letter of every word in upper case."""
    value = F.coalesce(blank_to_null(event_type), blank_to_null(event_name))
    pieces = F.split(F.regexp_replace(value, "[._-]+", " "), r"\b")
    titled = F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")
    return F.coalesce(titled, F.lit(fallback))


def present(events: DataFrame) -> DataFrame:
    """Add ``kind``, ``summary`` and ``display_severity``; columns the input lacks count as absent."""
    have = set(events.columns)

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    etype, ename = F.coalesce(F.trim(col("event_type")), F.lit("")), F.coalesce(F.trim(col("event_name")), F.lit(""))
    source = F.coalesce(F.trim(col("source_type")), F.lit(""))
    wire = F.upper(F.trim(col("source_event_type")))
    severity = normalized_severity(col("severity"))
    line = F.coalesce(*[blank_to_null(col(c)) for c in ("serial_log_line", "log_line", "data")])
    evidence = F.coalesce(line, blank_to_null(col("message")), blank_to_null(col("details")))
    metrics = [(label, col(c, "double")) for label, c in METRIC_LABELS]
    is_path = F.coalesce(line.rlike(DEVICE_PATH), F.lit(False))

    df = events.withColumns({"_type": etype, "_name": ename, "_line": line, "_evidence": evidence, "_path": is_path})
    t, n = F.col("_type"), F.col("_name")
    collector = (t == "serial.lifecycle") | t.startswith("serial.lifecycle.") | (t == "serial.event") | t.startswith("collector.")
    watchdog = t.startswith("watchdog.") | t.startswith("fault.") | n.rlike("(?i)watchdog|fault")
    telemetry = t.startswith("telemetry.") | F.coalesce(*[m for _, m in metrics]).isNotNull()
    kind = (
        F.when((t == "serial.log") & F.col("_path"), "COLLECTOR").when(t == "serial.log", "SERIAL")
        .when(collector, "COLLECTOR").when(n == "status", "LIFECYCLE")
        .when((n == "") & (t == "telemetry.status"), "LIFECYCLE")
        .when(watchdog, "WATCHDOG").when(telemetry, "TELEMETRY")
        .when(severity.isin("error", "critical"), "ERROR")
        .when((t == "") & wire.isin("SERIAL_CONNECTED", "SERIAL_DISCONNECTED", "SERIAL_MISSING"), "COLLECTOR")
        .when((t == "") & (n == "serialLog") & F.col("_line").isNotNull(), "SERIAL")
        .when((t == "") & (source == "serial-forwarder"), "COLLECTOR")
        .otherwise("EVENT")
    )
    metric_text = F.concat_ws(" ", *[F.concat(F.lit(f"{label}="), number_text(m)) for label, m in metrics])

    own = F.when((t == "serial.log") & F.col("_path"), "Serial device connected")
    for event_type, text in COLLECTOR_TEXT.items():
        own = own.when(t == event_type, text)
    own = (
        own.when(t.startswith("collector."), friendly(t, F.lit(""), "Serial Forwarder event"))
        .when(t == "serial.lifecycle", "Serial device lifecycle event").otherwise("Serial Forwarder event")
    )
    found = F.col("_evidence")
    collector_text = F.when(found.isNotNull() & (found != own), F.concat(own, F.lit(": "), found)).otherwise(own)
    telemetry_text = (
        F.when(metric_text != "", metric_text).when(t == "telemetry.occupancy", "Occupancy report")
        .when(t == "telemetry.health", "Telemetry health report").otherwise(friendly(t, n, "Telemetry event"))
    )
    k = F.col("kind")
    summary = (
        F.when(k == "SERIAL", F.coalesce("_line", F.lit("Serial log event")))
        .when(k == "COLLECTOR", collector_text)
        .when(k == "LIFECYCLE", "Device status event")
        .when(k == "WATCHDOG", F.coalesce(found, friendly(t, n, "Watchdog event")))
        .when(k == "TELEMETRY", telemetry_text)
        .when(k == "ERROR", F.coalesce(found, friendly(t, n, "Error event")))
        .otherwise(friendly(t, n, "Event"))
    )
    return (
        df.withColumn("kind", kind).withColumns({"summary": summary, "display_severity": severity})
        .drop("_type", "_name", "_line", "_evidence", "_path")
    )


def of_kinds(presented: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Kind include and exclude sets."""
    if include is not None:
        presented = presented.filter(F.col("kind").isin(include))
    if exclude is not None:
        presented = presented.filter(~F.col("kind").isin(exclude))
    return presented


def serial_log(
    events: DataFrame, include_collector: bool = False, contains: str | None = None, limit: int | None = None
) -> DataFrame:
    """Serial lines in time order, oldest ``limit`` rows per device."""
    rows = of_kinds(present(events), ["SERIAL", "COLLECTOR"] if include_collector else ["SERIAL"])
    if contains:
        rows = rows.filter(F.col("summary").contains(contains))
    if limit is not None:
        rows = newest(rows, ["device_id"], [F.col("event_time").asc(), F.col("event_id").asc()], limit)
    return rows
