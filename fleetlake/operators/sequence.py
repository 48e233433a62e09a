"""Gaps, bursts, anchored windows, throttled triggers and timeline anomalies per device.

Inputs are index rows: one per device and event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlake.functions.values import MICROS_PER_MINUTE, micros_between
from fleetlake.operators.anchored import label_events, window_labels
from fleetlake.operators.ordered import AUTO, Slices, newest, previous, scan

DEVICE = ["device_id"]
ORDER = ["event_time"]


def gaps(events: DataFrame, minutes: float = 90, slices: Slices | str | None = AUTO) -> DataFrame:
    """Neighbouring events of a device more than ``minutes`` apart."""
    seen = scan(
        events.select(*DEVICE, *ORDER, "event_name"), DEVICE, ORDER,
        {"prev": previous(F.struct("event_time", "event_name"))}, slices,
    )
    length = micros_between(F.col("prev.event_time"), F.col("event_time"))
    return seen.filter(length > int(minutes * MICROS_PER_MINUTE)).select(
        *DEVICE, F.col("prev.event_time").alias("gap_start"), F.col("event_time").alias("gap_end"),
        F.floor(length / MICROS_PER_MINUTE + 0.5).cast("bigint").alias("duration_minutes"),
        F.col("prev.event_name").alias("event_before"), F.col("event_name").alias("event_after"),
    )


def anchored_windows(events: DataFrame, minutes: float, slices: Slices | str | None = AUTO) -> DataFrame:
    """Every event with the start of its anchored window (an event at start + width still belongs)."""
    return label_events(events, DEVICE, "event_time", int(minutes * MICROS_PER_MINUTE), 1, slices)


def burst_events(events: DataFrame, minutes: float = 10, min_size: int = 3, slices: Slices | str | None = AUTO) -> DataFrame:
    """Members of bursts: at least ``min_size`` events within ``minutes`` of the first."""
    return label_events(events, DEVICE, "event_time", int(minutes * MICROS_PER_MINUTE), min_size, slices)


def bursts(events: DataFrame, minutes: float = 10, min_size: int = 3, slices: Slices | str | None = AUTO) -> DataFrame:
    """One row per burst; ``burst_events`` has the members."""
    members = burst_events(events.select(*DEVICE, "event_time", "event_name"), minutes, min_size, slices)
    return members.groupBy(*DEVICE, F.col("window_start").alias("burst_start")).agg(
        F.max("event_time").alias("burst_end"), F.count(F.lit(1)).alias("event_count")
    )


def throttled(eligible: DataFrame, seconds: float, time: str = "received_at", slices: Slices | str | None = AUTO) -> DataFrame:
    """First eligible event of a device, then the first one at least ``seconds`` after the last trigger."""
    if seconds <= 0:
        return eligible
    width = int(seconds * 1_000_000) - 1
    labels = window_labels(eligible, DEVICE, time, width, 1, slices)
    anchors = labels.filter(F.col("t") == F.col("anchor")).select(*DEVICE, "t")
    fired = eligible.withColumn("t", F.unix_micros(time)).join(anchors, [*DEVICE, "t"], "left_semi")
    return newest(fired, [*DEVICE, "t"], [F.col("event_id").asc()]).drop("t")


def ingest_delay(events: DataFrame) -> DataFrame:
    """Average, smallest and largest delivery delay per device in milliseconds."""
    delay = micros_between(F.col("event_time"), F.col("received_at")) / 1000
    return events.groupBy(*DEVICE).agg(
        F.floor(F.avg(delay) + 0.5).cast("bigint").alias("avg_delay_ms"),
        F.min(delay).alias("min_delay_ms"), F.max(delay).alias("max_delay_ms"),
    )


def timeline_anomalies(
    events: DataFrame, burst_minutes: float = 10, burst_limit: int = 3, delay_limit_ms: float = 5000, slices: Slices | str | None = AUTO
) -> DataFrame:
    """Repeated bursts, missing event times and deliveries far slower than the device's average."""
    none = F.lit(None).cast("timestamp")
    repeated = bursts(events, burst_minutes, 3, slices).groupBy(*DEVICE).agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > burst_limit
    ).select(
        *DEVICE, F.lit("repeated_burst").alias("type"), F.lit("medium").alias("severity"), none.alias("event_time"),
        F.concat(F.lit("Detected "), F.col("n").cast("string"), F.lit(f" event bursts (3+ events within {burst_minutes:g} minutes)")).alias("description"),
    )
    missing = events.filter(F.col("event_time").isNull()).select(
        *DEVICE, F.lit("missing_eventTime").alias("type"), F.lit("high").alias("severity"), none.alias("event_time"),
        F.concat(F.lit("Event "), F.col("event_name"), F.lit(" missing eventTime")).alias("description"),
    )
    delay = micros_between(F.col("event_time"), F.col("received_at")) / 1000
    # Only deliveries above the absolute limit need the device average.
    late = events.select(*DEVICE, "event_time", "event_name", delay.alias("delay")).filter(F.col("delay") > delay_limit_ms)
    slow = late.join(ingest_delay(events).select(*DEVICE, "avg_delay_ms"), "device_id").filter(
        F.col("delay") > F.col("avg_delay_ms") * 2
    ).select(
        *DEVICE, F.lit("high_ingest_delay").alias("type"), F.lit("low").alias("severity"), "event_time",
        F.concat(F.lit("High ingest delay: "), F.floor(F.col("delay") + 0.5).cast("bigint").cast("string"), F.lit("ms for "), F.col("event_name")).alias("description"),
    )
    return repeated.unionByName(missing).unionByName(slow)
