"""Device queries: timeline, health, summary, anomalies, timeline analytics, payload health, correlation.

Each answers for all devices at once; pass ``device_id`` for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlake.functions.values import hours_between
from fleetlake.operators import correlate, rules, sequence
from fleetlake.operators.archive import payload_metrics, with_payload
from fleetlake.operators.filters import QueryWindow, events_between
from fleetlake.operators.ordered import AUTO, Slices, newest
from fleetlake.session import cut_lineage

TIMELINE_COLUMNS = [
    "device_id", "event_time", "event_name", "archive_key", "event_id", "event_type", "plane", "severity", "fw_version",
    "battery", "connect_time", "reset_count", "alert_count", "temperature", "occupancy", "daily_occupancy",
    "serial_log_line", "log_line",
]
HEALTH_METRICS = ["battery", "connect_time", "reset_count", "alert_count", "temperature"]
LIFECYCLE_NAMES = ["SERIAL_CONNECTED", "SERIAL_DISCONNECTED", "SERIAL_MISSING", "LOG"]


def in_window(events: DataFrame, window: QueryWindow | None, device_id: str | None, newest_first: bool, per_device_limit: bool) -> DataFrame:
    """Events of the window; with ``per_device_limit`` at most ``window.limit`` of each device."""
    if window is None:
        return events_between(events, device_id=device_id)
    rows = events_between(events, window.start, window.end, device_id)
    if not per_device_limit:
        return rows
    time, tie = F.col("event_time"), F.col("event_id")
    order = [time.desc(), tie.desc()] if newest_first else [time.asc(), tie.asc()]
    return newest(rows, ["device_id"], order, window.limit)


def timeline(events: DataFrame, window: QueryWindow, device_id: str | None = None) -> DataFrame:
    """Newest events of the window, optional columns null when absent."""
    return in_window(events, window, device_id, True, True).select(*TIMELINE_COLUMNS)


def metric_stats(metric: str) -> list[Column]:
    """Latest, min, max, average, count and change; the change needs two readings."""
    m = F.col(metric)
    at = F.when(m.isNotNull(), F.col("event_time"))
    first, last = F.min_by(metric, at), F.max_by(metric, at)
    return [
        last.alias(f"{metric}_latest"), F.min(m).alias(f"{metric}_min"), F.max(m).alias(f"{metric}_max"),
        F.avg(m).alias(f"{metric}_average"), F.count(m).alias(f"{metric}_count"),
        F.when(F.count(m) > 1, last - first).alias(f"{metric}_change"),
    ]


def version_list(*columns: str) -> Column:
    """Distinct versions in text order, as one text."""
    value = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])
    return F.array_join(F.array_sort(F.collect_set(value)), ",")


def health(
    events: DataFrame, window: QueryWindow | None = None, device_id: str | None = None, limited: bool = False, digits: int | None = None
) -> DataFrame:
    """Metric statistics, occupancy, versions and time span per device in one aggregation."""
    rows = in_window(events, window, device_id, False, limited)
    shown = [f"{m}_{s}" for m in HEALTH_METRICS for s in ("latest", "min", "max", "average", "change")]
    at = F.when(F.col("occupancy").isNotNull(), F.col("event_time"))
    stats = rows.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
        *[c for m in HEALTH_METRICS for c in metric_stats(m)],
        F.max_by("occupancy", at).alias("occupancy_latest"), F.sum("occupancy").alias("occupancy_total"),
        version_list("fw_version").alias("firmware_versions"),
    ).withColumn("hours", F.round(hours_between(F.col("first_event"), F.col("last_event")), 1))
    return stats if digits is None else stats.withColumns({c: F.round(c, digits) for c in shown})


def anomalies(
    events: DataFrame, window: QueryWindow | None = None, device_id: str | None = None, limited: bool = False, slices: Slices | str | None = AUTO
) -> DataFrame:
    """Anomalies, worst first, then newest; a device without any simply has no rows."""
    found = rules.device_anomalies(in_window(events, window, device_id, False, limited), slices)
    if window is not None and window.severity:
        found = rules.at_least(found, window.severity)
    return rules.by_severity_then_newest(found)


def type_counts(events: DataFrame) -> DataFrame:
    """Events per device and type, largest first."""
    kind = F.coalesce(F.nullif(F.col("event_type"), F.lit("")), F.nullif(F.col("event_name"), F.lit("")), F.lit("unknown"))
    counted = events.groupBy("device_id", kind.alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy("device_id", F.col("n").desc(), "event_type")


def plane_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("device_id", F.coalesce(F.nullif(F.col("plane"), F.lit("")), F.lit("unknown")).alias("plane")).agg(F.count(F.lit(1)).alias("n"))


def summary(
    events: DataFrame, window: QueryWindow, device_id: str | None = None, limited: bool = False, slices: Slices | str | None = AUTO
) -> DataFrame:
    """Counts in the window, first and last event ever, versions and number of anomalies per device."""
    rows = in_window(events, window, device_id, False, limited)
    inside = rows.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        *[F.count_if(F.col("plane") == p).alias(f"{p}_events") for p in ("telemetry", "forensic", "serial")],
        version_list("fw_version", "legacy_fw_version").alias("firmware_versions"),
    )
    ever = events_between(events, device_id=device_id).groupBy("device_id").agg(
        F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event")
    )
    found = rules.device_anomalies(rows, slices).groupBy("device_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    return (
        inside.join(ever, "device_id").join(found, "device_id", "left")
        .withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0)))
        .withColumn("hours", F.round(hours_between(F.col("first_event"), F.col("last_event")), 1))
    )


def exists(events: DataFrame, devices: DataFrame) -> DataFrame:
    """The given devices that have at least one event."""
    return devices.join(events.select("device_id"), "device_id", "left_semi")


def name_counts(events: DataFrame) -> DataFrame:
    """Events per device and name."""
    return events.groupBy("device_id", "event_name").agg(F.count(F.lit(1)).alias("n"))


def timeline_analytics(
    events: DataFrame, gap_minutes: float = 90, burst_minutes: float = 10, slices: Slices | str | None = AUTO
) -> DataFrame:
    """Timeline summary per device: counts, delays, versions, lifecycle counters, gaps, bursts and anomalies."""
    name = F.col("event_name")
    base = events.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
        version_list("legacy_fw_version").alias("firmware_versions"),
        *[F.count_if(name == n).alias(n.lower()) for n in LIFECYCLE_NAMES],
    ).join(sequence.ingest_delay(events), "device_id")

    def count(df: DataFrame, alias: str) -> DataFrame:
        return df.groupBy("device_id").agg(F.count(F.lit(1)).alias(alias))

    parts = {
        "gap_count": sequence.gaps(events, gap_minutes, slices),
        "burst_count": sequence.bursts(events, burst_minutes, 3, slices),
        "anomaly_count": sequence.timeline_anomalies(events, burst_minutes, slices=slices),
    }
    for alias, df in parts.items():
        base = base.join(count(df, alias), "device_id", "left").withColumn(alias, F.coalesce(alias, F.lit(0)))
    return base


def payload_health(events: DataFrame, archive: DataFrame, slices: Slices | str | None = AUTO) -> DataFrame:
    """Findings over archived payloads; firmware comes from the payload records."""
    joined = with_payload(events, archive).filter("has_payload")
    metrics = payload_metrics(joined)
    versions = joined.withColumn("fw_version", F.nullif(F.col("archived_fw_version"), F.lit("")))
    return rules.payload_anomalies(metrics, rules.firmware_changes(versions, slices))


def payload_stats(events: DataFrame, archive: DataFrame) -> DataFrame:
    """Payload metric statistics per device."""
    metrics = payload_metrics(with_payload(events, archive).filter("has_payload"))
    return metrics.groupBy("device_id").agg(*[c for m in HEALTH_METRICS for c in metric_stats(m)])


def payload_summary(events: DataFrame, archive: DataFrame) -> DataFrame:
    """Time span over all events; versions and statistics over those with a payload."""
    rows = payload_metrics(with_payload(events, archive))
    return rows.withColumns({m: F.when(F.col("has_payload"), F.col(m)) for m in HEALTH_METRICS}).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
        version_list("archived_fw_version").alias("firmware_versions"), *[c for m in HEALTH_METRICS for c in metric_stats(m)],
    ).withColumn("hours", F.round(hours_between(F.col("first_event"), F.col("last_event")), 1))


def correlation(events: DataFrame, archive: DataFrame, minutes: float = 5, slices: Slices | str | None = AUTO, reused: bool = False):
    """Members, windows and inferences of anchored windows; ``reused`` members are written once, with the columns that windows and evidence read."""
    members = correlate.window_members(events, archive, minutes, slices)
    members = cut_lineage(members.select(*correlate.MEMBER)) if reused else members
    windows = correlate.windows(members)
    return members, windows, correlate.inferences(windows)


def counts(events: DataFrame) -> DataFrame:
    """(device_id, kind, value, n): events per device by type, by plane and by name, from one scan and one shuffle."""
    named = events.select(
        "device_id", F.coalesce(F.nullif(F.col("event_type"), F.lit("")), F.nullif(F.col("event_name"), F.lit("")), F.lit("unknown")).alias("type"),
        F.coalesce(F.nullif(F.col("plane"), F.lit("")), F.lit("unknown")).alias("plane"), F.col("event_name").alias("name"))
    kinds = ["type", "plane", "name"]
    sets = named.groupingSets([["device_id", k] for k in kinds], "device_id", *kinds).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(k).alias(f"_{k}") for k in kinds])
    kind, value = None, None
    for k in kinds:
        here = F.col(f"_{k}") == 0
        kind = F.when(here, k) if kind is None else kind.when(here, k)
        value = F.when(here, F.col(k)) if value is None else value.when(here, F.col(k))
    return sets.select("device_id", kind.alias("kind"), value.alias("value"), "n")
