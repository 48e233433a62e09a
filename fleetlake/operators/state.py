"""Fold of all arrivals of a device into its current state, as running values in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlake.operators.normalize import METRICS
from fleetlake.operators.ordered import AUTO, Slices, first_known, last_known, previous, resolved, running_sum, scan

KEY = ["project_id", "device_id"]
ARRIVAL_ORDER = ["received_at", "event_time", "event_id"]
OFFLINE_HOURS = 3
FLAGS = ["reconnect_detected", "watchdog_detected", "reset_detected"]

STATE_COLUMNS = [
    *KEY, "device_name", "last_event_time", "last_application_report_at", "last_ingest_time", "last_event_id",
    "last_event_type", "last_plane", "last_source_type", "fw_version", *METRICS, "severity", "network_state",
    "serial_category", "last_serial_log_line", "recent_serial_error_count", *FLAGS, "health_status",
    "anomaly_count", "anomalies",
]


def _anomaly(severity: str, kind: str, message: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.lit(message).alias("message"))


def state_anomalies(battery, connect_time, alert_count, severity, watchdog, reconnect, reset) -> Column:
    """Anomalies of an effective state, fixed order, at most ten."""
    return F.slice(F.array_compact(F.array(
        F.when(battery < 20, _anomaly("high", "critical_battery", "Battery below 20%"))
        .when(battery < 30, _anomaly("medium", "low_battery", "Battery below 30%")),
        F.when(connect_time > 300, _anomaly("high", "very_high_connect_time", "Connect time exceeded 300 seconds"))
        .when(connect_time > 180, _anomaly("medium", "high_connect_time", "Connect time exceeded 180 seconds")),
        F.when(alert_count > 0, _anomaly("high", "active_alerts", "Active alert count is non-zero")),
        F.when(severity == "ERROR", _anomaly("high", "serial_error", "Latest serial event is ERROR severity"))
        .when(severity == "WARN", _anomaly("medium", "serial_warning", "Latest serial event is WARN severity")),
        F.when(watchdog, _anomaly("high", "serial_watchdog", "Serial log indicates watchdog activity")),
        F.when(reconnect, _anomaly("medium", "serial_reconnect", "Serial log indicates reconnect or retry activity")),
        F.when(reset, _anomaly("medium", "serial_reset", "Serial log indicates reset, reboot, or panic activity")),
    )), 1, 10)


def own_health(plane, battery, connect_time, alert_count, severity, watchdog, reconnect, reset) -> Column:
    """Status decided by the event itself; null for a serial event without a signal."""
    serial = (
        F.when((severity == "ERROR") | watchdog, "critical")
        .when((severity == "WARN") | reconnect | reset, "warning")
    )
    signal = battery.isNotNull() | connect_time.isNotNull() | alert_count.isNotNull() | severity.isNotNull()
    other = (
        F.when((battery < 20) | (alert_count > 0) | (connect_time > 300) | (severity == "ERROR"), "critical")
        .when((battery < 30) | (connect_time > 180) | (severity == "WARN"), "warning")
        .when(signal, "healthy").otherwise("unknown")
    )
    return F.when(plane == "serial", serial).otherwise(other)


def state_history(arrivals: DataFrame, slices: Slices | str | None = AUTO, stored: DataFrame | None = None) -> DataFrame:
    """One row per arrival: the state after it, and the previous state values history needs.

    ``stored`` continues from saved states (``STATE_COLUMNS``). They are joined on the key the fold is
    partitioned by, and fill in where the batch has no value of its own yet.
    """
    slices = resolved(slices, arrivals, KEY, ARRIVAL_ORDER[0])
    is_serial, is_log = F.col("plane") == "serial", F.col("event_type") == "serial.log"
    outputs = {f"eff_{m}": last_known(F.col(m)) for m in METRICS}
    outputs |= {f"eff_{f}": last_known(F.col(f)) for f in FLAGS}
    outputs |= {
        "eff_fw_version": last_known(F.col("fw_version")),
        "eff_network_state": last_known(F.col("network_state")),
        "eff_severity": last_known(F.col("severity")),
        "eff_category": last_known(F.when(is_serial, F.struct(F.col("serial_category").alias("v")))),
        "last_serial_log_line": last_known(F.when(is_log, F.col("serial_log_line"))),
        "eff_device_name": first_known(F.col("device_name")),
        "recent_serial_error_count": running_sum(F.when(F.col("severity") == "ERROR", 1).otherwise(0).cast("bigint")),
        "last_application_report_at": last_known(F.when(F.col("plane") == "telemetry", F.col("event_time"))),
        "prev_fw_version": last_known(F.col("fw_version"), inclusive=False),
        "prev_battery": last_known(F.col("battery"), inclusive=False),
        "prev_event_time": previous(F.col("event_time")),
    }
    folded = scan(arrivals, KEY, ARRIVAL_ORDER, outputs, slices)
    if stored is not None:
        folded = _continued(folded.join(stored.select(*KEY, F.struct(*STATE_COLUMNS).alias("_saved")), KEY, "left"))
    effective = [F.col(f"eff_{m}") for m in ("battery", "connect_time", "alert_count")]
    flags = [F.col(f"eff_{f}") for f in ("watchdog_detected", "reconnect_detected", "reset_detected")]
    judged = folded.withColumns({
        "own_status": own_health(F.col("plane"), *effective, F.col("severity"), *flags),
        "anomalies": effective_anomalies(),
    })
    carried = scan(judged, KEY, ARRIVAL_ORDER, {"carried_status": last_known(F.col("own_status"))}, slices)
    saved_status = [] if stored is None else [F.col("_saved.health_status")]
    return carried.withColumn("health_status", F.coalesce("carried_status", *saved_status, F.lit("unknown"))).drop("_saved")


def _continued(folded: DataFrame) -> DataFrame:
    """Fill values the batch does not have yet from the saved state."""
    same = ["last_serial_log_line", "last_application_report_at"]
    filled = {c: F.coalesce(c, f"_saved.{c}") for c in same}
    filled |= {f"eff_{c}": F.coalesce(f"eff_{c}", f"_saved.{c}") for c in [*METRICS, *FLAGS, "fw_version", "network_state", "severity"]}
    filled |= {
        "eff_category": F.coalesce("eff_category", F.struct(F.col("_saved.serial_category").alias("v"))),
        "eff_device_name": F.coalesce("_saved.device_name", "eff_device_name"),
        "recent_serial_error_count": F.col("recent_serial_error_count") + F.coalesce("_saved.recent_serial_error_count", F.lit(0)),
        "prev_fw_version": F.coalesce("prev_fw_version", "_saved.fw_version"),
        "prev_battery": F.coalesce("prev_battery", "_saved.battery"),
        "prev_event_time": F.coalesce("prev_event_time", "_saved.last_event_time"),
    }
    return folded.withColumns(filled)


def state_columns() -> list[Column]:
    """The stored form of the state after an arrival, from the columns of ``state_history``."""
    return [
        *[F.col(k) for k in KEY],
        F.col("eff_device_name").alias("device_name"),
        F.col("event_time").alias("last_event_time"),
        F.col("last_application_report_at"),
        F.col("received_at").alias("last_ingest_time"),
        F.col("event_id").alias("last_event_id"),
        F.col("event_type").alias("last_event_type"),
        F.col("plane").alias("last_plane"),
        F.col("source_type").alias("last_source_type"),
        F.col("eff_fw_version").alias("fw_version"),
        *[F.col(f"eff_{m}").alias(m) for m in METRICS],
        F.col("eff_severity").alias("severity"),
        F.col("eff_network_state").alias("network_state"),
        F.col("eff_category.v").alias("serial_category"),
        F.col("last_serial_log_line"), F.col("recent_serial_error_count"),
        *[F.col(f"eff_{f}").alias(f) for f in FLAGS],
        F.col("health_status"),
        F.size("anomalies").alias("anomaly_count"),
        F.col("anomalies"),
    ]


def effective_anomalies() -> Column:
    """Anomalies of the effective state after an arrival, from the columns of ``state_history``."""
    effective = [F.col(f"eff_{m}") for m in ("battery", "connect_time", "alert_count")]
    return state_anomalies(*effective, F.col("severity"), *[F.col(f"eff_{f}") for f in ("watchdog_detected", "reconnect_detected", "reset_detected")])


def after_event(history: DataFrame) -> DataFrame:
    """Stored form of the state after each arrival."""
    return history.select(*state_columns())


def last_states(states: DataFrame) -> DataFrame:
    """Last state per device. Aggregates on the key the fold is already partitioned by."""
    position = F.struct("last_ingest_time", "last_event_time", "last_event_id")
    rest = F.struct(*[c for c in STATE_COLUMNS if c not in KEY])
    return states.groupBy(*KEY).agg(F.max_by(rest, position).alias("s")).select(*KEY, "s.*")


def current_state(arrivals: DataFrame, slices: Slices | str | None = AUTO, stored: DataFrame | None = None) -> DataFrame:
    """Current state of every device with an arrival."""
    return last_states(after_event(state_history(arrivals, slices, stored)))


def offline_candidate(event_time: Column, as_of: Column, hours: float = OFFLINE_HOURS) -> Column:
    """Strictly older than ``hours`` before ``as_of``."""
    return F.unix_micros(event_time) < F.unix_micros(as_of) - F.lit(int(hours * 3_600_000_000))


# Ledgers and the prefix of their columns in a stored state.
LEDGER_COLUMNS = {"device-status": "device_status", "device-data": "device_data", "product-defaults": "product_defaults", "device-settings": "device_settings"}


def stored_row(states: DataFrame, snapshots: DataFrame, resets: DataFrame, updated_at: str = "last_ingest_time") -> DataFrame:
    """The whole stored state of a device: the fold, when it was written, and what its ledgers project onto it.

    ``snapshots`` has one row per scope and ledger, ``resets`` one per scope. A device was an offline candidate if its last
    event was more than three hours old when the row was written.
    """
    own = {name: F.when(F.col("ledger_name") == name, F.struct("updated_at", "fetched_at", "size_bytes", "data")) for name in LEDGER_COLUMNS}
    per_device = snapshots.groupBy(F.col("scope_value").alias("_scope")).agg(*[F.first(c, ignorenulls=True).alias(f"_{LEDGER_COLUMNS[name]}") for name, c in own.items()])
    fields = [F.col(f"_{p}.{f}").alias(f"{p}_{f}") for p in LEDGER_COLUMNS.values() for f in ("updated_at", "fetched_at", "size_bytes", "data")]
    counted = resets.select(F.col("scope_value").alias("_counted"), "firmware_reset_count", "startup_reset_count")
    dated = states.withColumn("updated_at", F.col(updated_at))
    joined = dated.join(per_device, F.col("device_id") == F.col("_scope"), "left").join(counted, F.col("device_id") == F.col("_counted"), "left")
    return joined.select(
        *dated.columns, offline_candidate(F.col("last_event_time"), F.col("updated_at")).alias("offline_candidate"),
        *fields, "firmware_reset_count", "startup_reset_count",
    )


def with_names(devices: DataFrame, names: DataFrame) -> DataFrame:
    """A stored name is kept; devices without one take the looked-up name."""
    looked_up = names.select(F.col("device_id"), F.nullif(F.trim("device_name"), F.lit("")).alias("_name"))
    own = F.nullif(F.trim("device_name"), F.lit(""))
    return devices.join(looked_up, "device_id", "left").withColumn("device_name", F.coalesce(own, F.col("_name"))).drop("_name")


def merge_state(stored: DataFrame, update: DataFrame, value_columns: list[str]) -> DataFrame:
    """Partial update: a non-null new value replaces the stored one, the rest is kept."""
    o, n = stored.alias("o"), update.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEY]
    return o.join(n, on, "full_outer").select(
        *[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in KEY],
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in value_columns],
    )
