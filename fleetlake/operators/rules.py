"""Anomaly and health rules over the event index and over payload metrics.

The index has one row per device and event time, so event time alone orders a device.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlake.functions.values import fixed_text, number_text
from fleetlake.operators.ordered import AUTO, Slices, previous, scan

SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3}
ORDER = ["event_time"]
ANOMALY_COLUMNS = ["device_id", "event_time", "severity", "type", "message", "value_num", "value_str"]


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), F.lower(severity))


def _finding(severity: str, kind: str, message: Column, value: Column) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(kind).alias("type"), message.alias("message"),
        value.alias("value_num"), F.lit(None).cast("string").alias("value_str"),
    )


def threshold_anomalies(events: DataFrame) -> DataFrame:
    """Per-event limits on battery, connect time and alerts. Row-local, no shuffle."""
    b, c, a = F.col("battery"), F.col("connect_time"), F.col("alert_count")

    def battery(level: str) -> Column:
        return F.concat(F.lit(f"{level} battery level: "), fixed_text(b, 1), F.lit("%"))

    def connect(level: str, limit: int) -> Column:
        return F.concat(F.lit(f"{level} connection time: "), number_text(c), F.lit(f"s (threshold: {limit}s)"))

    found = F.array_compact(F.array(
        F.when(b < 20, _finding("high", "critical_battery", battery("Critical"), b))
        .when(b < 30, _finding("medium", "low_battery", battery("Low"), b)),
        F.when(c > 300, _finding("high", "very_high_connect_time", connect("Very high", 300), c))
        .when(c > 180, _finding("medium", "high_connect_time", connect("High", 180), c)),
        F.when(a > 0, _finding("high", "active_alerts", F.concat(F.lit("Active alerts detected: "), number_text(a)), a)),
    ))
    return (
        events.filter((b < 30) | (c > 180) | (a > 0))
        .select("device_id", "event_time", F.explode(found).alias("f"))
        .select("device_id", "event_time", "f.*")
    )


def firmware_changes(events: DataFrame, slices: Slices | str | None = AUTO) -> DataFrame:
    """Neighbouring reports with different firmware; reports without a version are skipped first."""
    reports = events.filter(F.coalesce(F.col("fw_version"), F.lit("")) != "").select("device_id", *ORDER, "fw_version")
    seen = scan(reports, ["device_id"], ORDER, {"from_version": previous(F.col("fw_version"))}, slices)
    return seen.filter(F.col("fw_version") != F.col("from_version")).select(
        "device_id", F.col("event_time").alias("changed_at"), "from_version", F.col("fw_version").alias("to_version")
    )


def first_and_last(events: DataFrame, metric: str) -> DataFrame:
    """First and last reading of a metric per device; hash aggregation, partial before the shuffle."""
    at = F.when(F.col(metric).isNotNull(), F.col("event_time"))
    return events.groupBy("device_id").agg(
        F.min_by(metric, at).alias("first_value"),
        F.max_by(metric, at).alias("last_value"),
        F.max(at).alias("last_at"),
        F.count(metric).alias("readings"),
    )


def battery_drain(events: DataFrame) -> DataFrame:
    """Devices that lost more than 30 points and more than 30 % between first and last reading."""
    span = first_and_last(events, "battery").withColumn("drop", F.col("first_value") - F.col("last_value"))
    span = span.withColumn("drop_percent", F.try_divide("drop", "first_value") * 100)
    return span.filter((F.col("readings") > 1) & (F.col("drop") > 30) & (F.col("drop_percent") > 30))


def reset_increase(events: DataFrame, metric: str = "reset_count") -> DataFrame:
    """Devices whose reset count rose between first and last reading; more than 3 is high."""
    span = first_and_last(events, metric).withColumn("increase", F.col("last_value") - F.col("first_value"))
    return span.filter((F.col("readings") > 1) & (F.col("increase") > 0)).withColumn(
        "severity", F.when(F.col("increase") > 3, "HIGH").otherwise("MEDIUM")
    )


def drain_message(drop: Column, percent: Column) -> Column:
    return F.concat(
        F.lit("Rapid battery drain: "), fixed_text(drop, 1), F.lit("% drop ("), fixed_text(percent, 0), F.lit("% of initial)")
    )


def change_text(old: Column, new: Column) -> Column:
    return F.concat(old, F.lit(" → "), new)


def change_message(old: Column, new: Column) -> Column:
    return F.concat(F.lit("Firmware changed from "), old, F.lit(" to "), new)


def device_anomalies(events: DataFrame, slices: Slices | str | None = AUTO) -> DataFrame:
    """Threshold, firmware-change and battery-drain anomalies of all devices."""
    none_num, none_str = F.lit(None).cast("double"), F.lit(None).cast("string")
    old, new = F.col("from_version"), F.col("to_version")
    changes = firmware_changes(events, slices).select(
        "device_id", F.col("changed_at").alias("event_time"), F.lit("low").alias("severity"),
        F.lit("firmware_change").alias("type"), change_message(old, new).alias("message"),
        none_num.alias("value_num"), change_text(old, new).alias("value_str"),
    )
    drains = battery_drain(events).select(
        "device_id", F.col("last_at").alias("event_time"), F.lit("medium").alias("severity"),
        F.lit("rapid_battery_drain").alias("type"), drain_message(F.col("drop"), F.col("drop_percent")).alias("message"),
        F.col("drop").alias("value_num"), none_str.alias("value_str"),
    )
    return threshold_anomalies(events).select(*ANOMALY_COLUMNS).unionByName(changes).unionByName(drains)


def at_least(anomalies: DataFrame, severity: str) -> DataFrame:
    """Keep anomalies of the given minimum severity."""
    rank = SEVERITY_RANK.get(severity.lower())
    if rank is None:
        raise ValueError(f"severity must be one of {sorted(SEVERITY_RANK)}, got {severity!r}")
    return anomalies.filter(severity_rank(F.col("severity")) >= rank)


def by_severity_then_newest(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy(severity_rank(F.col("severity")).desc(), F.col("event_time").desc(), "device_id", "type")


def payload_anomalies(metrics: DataFrame, changes: DataFrame) -> DataFrame:
    """Health rules over payload metrics: one aggregate per device, then one row per finding."""
    def readings(m: str) -> list[Column]:
        at = F.when(F.col(m).isNotNull(), F.col("event_time"))
        return [
            F.min_by(m, at).alias(f"{m}_first"), F.max_by(m, at).alias(f"{m}_last"),
            F.count(m).alias(f"{m}_n"), F.max(m).alias(f"{m}_max"),
        ]

    per_device = metrics.groupBy("device_id").agg(
        *[c for m in ("battery", "connect_time", "reset_count", "alert_count") for c in readings(m)],
        F.count_if(F.col("connect_time") > 180).alias("slow_connects"),
        F.count_if(F.col("alert_count") > 0).alias("alert_events"),
    ).withColumns({
        "drop": F.col("battery_first") - F.col("battery_last"),
        "increase": F.col("reset_count_last") - F.col("reset_count_first"),
    }).withColumn("drop_percent", F.try_divide("drop", "battery_first") * 100)

    def finding(severity: Column, metric: str, message: Column, value: Column) -> Column:
        return F.struct(
            severity.alias("severity"), F.lit(metric).alias("metric"), message.alias("message"),
            value.cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_str"),
            F.lit(None).cast("timestamp").alias("event_time"),
        )

    b, c, cmax, r, a = (F.col(x) for x in ("battery_last", "connect_time_last", "connect_time_max", "increase", "alert_count_last"))
    found = F.array_compact(F.array(
        F.when(b < 30, finding(
            F.when(b < 20, "HIGH").otherwise("MEDIUM"), "battery",
            F.concat(F.lit("Battery critically low: "), fixed_text(b, 1), F.lit("%")), b)),
        F.when((F.col("battery_n") > 1) & (F.col("drop") > 30) & (F.col("drop_percent") > 30), finding(
            F.lit("MEDIUM"), "battery", drain_message(F.col("drop"), F.col("drop_percent")), F.col("drop"))),
        F.when(c > 180, finding(
            F.when(c > 300, "HIGH").otherwise("MEDIUM"), "connecttime",
            F.concat(F.lit("High connection time: "), number_text(c), F.lit("s (threshold: 180s)")), c)),
        F.when(cmax > 180, finding(
            F.lit("LOW"), "connecttime",
            F.concat(F.col("slow_connects").cast("string"), F.lit(" event(s) with connection time > 180s (max: "), number_text(cmax), F.lit("s)")), cmax)),
        F.when((F.col("reset_count_n") > 1) & (r > 0), finding(
            F.when(r > 3, "HIGH").otherwise("MEDIUM"), "resets",
            F.concat(F.lit("Reset count increased by "), number_text(r), F.lit(" (from "), number_text(F.col("reset_count_first")),
                     F.lit(" to "), number_text(F.col("reset_count_last")), F.lit(")")), r)),
        F.when(F.col("alert_events") > 0, finding(
            F.when(a > 0, "HIGH").otherwise("MEDIUM"), "alerts",
            F.concat(F.lit("Active alerts detected: "), F.col("alert_events").cast("string"),
                     F.lit(" event(s) with alerts > 0 (latest: "), number_text(a), F.lit(")")), a)),
    ))
    old, new = F.col("from_version"), F.col("to_version")
    firmware = changes.select(
        "device_id", F.lit("LOW").alias("severity"), F.lit("firmware").alias("metric"), change_message(old, new).alias("message"),
        F.lit(None).cast("double").alias("value_num"), change_text(old, new).alias("value_str"), F.col("changed_at").alias("event_time"),
    )
    return per_device.select("device_id", F.explode(found).alias("f")).select("device_id", "f.*").unionByName(firmware)
