"""Continuous current state and history of every device, by one stateful operator.

Arrivals and the fetches they trigger meet per device. The operator keeps the folded state of a device and the triggers whose fetches are still
out; it returns every arrival with the state after it and what history compares it with, and every failed fetch with the time and
id of its trigger. State rows and history items of a batch leave it in one pass and are written by one job.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlake.functions.values import iso
from fleetlake.operators import history, ledgers, state
from fleetlake.operators.normalize import METRICS
from fleetlake.session import TWO_FOLDERS, settings
from fleetlake.sources.tables import CODEC
from fleetlake.sources.versions import BATCH, Files, Versions
from fleetlake.streaming.keyed import Memory, from_micros, in_micros, keyed, struct

ARRIVAL = [
    *state.KEY, "received_at", "event_time", "event_time_text", "event_id", "event_type", "plane", "source_type", "payload_digest", "device_name",
    "fw_version", *METRICS, "severity", "network_state", "serial_category", "serial_log_line", *state.FLAGS,
]
LAST = [*METRICS, *state.FLAGS, "fw_version", "network_state", "severity"]  # the last known value counts
INSTANTS = ["received_at", "event_time", "last_application_report_at", "prev_event_time"]
TRIGGER = "event_time long, event_time_text string, received_at long"
TRIGGER_HOURS = 24  # how long a trigger waits for its fetch, by the device's own deliveries

STATE = ", ".join([
    "device_name string", "last_event_time long", "last_application_report_at long", *[f"{m} double" for m in METRICS], *[f"{f} boolean" for f in state.FLAGS],
    "fw_version string", "network_state string", "severity string", "serial_category string", "last_serial_log_line string",
    "recent_serial_error_count long", "health_status string",
])
FOLDED = ", ".join([
    "kind string", *[f"{c} string" for c in state.KEY], "received_at long", "event_time long", "event_time_text string", "event_id string", "event_type string",
    "plane string", "source_type string", "payload_digest string", "fw_version string", "severity string", *[f"eff_{m} double" for m in METRICS],
    *[f"eff_{f} boolean" for f in state.FLAGS], "eff_fw_version string", "eff_network_state string", "eff_severity string", "serial_category string",
    "last_serial_log_line string", "eff_device_name string", "recent_serial_error_count long", "last_application_report_at long",
    "prev_fw_version string", "prev_battery double", "prev_event_time long", "health_status string", "newest boolean",
    "outcome string", "http_status int",
])


AFTER = ("serial_category", "last_serial_log_line", "recent_serial_error_count", "last_application_report_at", "health_status")
NUMBERS = ("battery", "connect_time", "alert_count")
SIGNS = ("watchdog_detected", "reconnect_detected", "reset_detected")


def own_status(*columns) -> np.ndarray:
    """``state.own_health`` over columns of values; absent values are None."""
    out = np.empty(len(columns[0]), object)
    out[:] = [_status(*values) for values in zip(*columns)]
    return out


def _status(plane, battery, connect_time, alert_count, severity, watchdog, reconnect, reset) -> str | None:
    serial = plane == "serial"
    if serial:
        critical, warning = severity == "ERROR" or watchdog is True, severity == "WARN" or reconnect is True or reset is True
    else:
        low, slow = 100 if battery is None else battery, 0 if connect_time is None else connect_time
        critical = severity == "ERROR" or low < 20 or slow > 300 or alert_count is not None and alert_count > 0
        warning = severity == "WARN" or low < 30 or slow > 180
    if critical or warning or serial:
        return "critical" if critical else "warning" if warning else None
    return "unknown" if battery is None and connect_time is None and alert_count is None and severity is None else "healthy"


def fold(rows: list[dict], saved: dict | None, triggers: Memory | None = None) -> tuple[list[dict], dict | None]:
    """The rows of one device in arrival order, continued from its saved state; failed fetches take time and id of their trigger."""
    arrivals = [r for r in rows if r["kind"] == "arrival"]
    fetches = [r for r in rows if r["kind"] == "fetch"]
    out, new = _folded(arrivals, saved) if arrivals else ([], None)
    if fetches or triggers is not None:
        # A fetch may land with its trigger or in a later batch.
        waiting = {r["event_id"]: (r["event_time"], r["event_time_text"], r["received_at"]) for r in arrivals if r["is_trigger"]}
        asked = {r["trigger_event_id"] for r in fetches} - {None}
        causes = {e: waiting.get(e) or (triggers.get(e) if triggers is not None else None) for e in asked}
        if triggers is not None:
            _remember(triggers, waiting, asked, max((r["received_at"] for r in rows if r["received_at"] is not None), default=0))
        for r in fetches:
            if r["outcome"] != "ok":
                cause = causes.get(r["trigger_event_id"])
                event_id, (time, text, _) = (r["trigger_event_id"], cause) if cause else (None, (None, None, None))
                out.append({**r, "event_id": event_id, "event_time": time, "event_time_text": text})
    return out, new


def _remember(triggers: Memory, waiting: dict, answered: set, now) -> None:
    """Triggers wait until their fetch comes, whatever it says, or until TRIGGER_HOURS of later deliveries have passed."""
    for e in answered - waiting.keys():
        if triggers.get(e) is not None:
            triggers.drop(e)
    left = {e: v for e, v in waiting.items() if e not in answered}
    for e, v in left.items():
        triggers.put(e, v)
    if left:
        for e, (_, _, received) in triggers.items():
            if received is not None and received < now - TRIGGER_HOURS * 3_600_000_000:
                triggers.drop(e)


def _folded(rows: list[dict], saved: dict | None) -> tuple[list[dict], dict]:
    """Every row with the state after it, and the last state."""
    now = dict(saved) if saved else dict.fromkeys(struct(STATE).names)
    now["recent_serial_error_count"] = now["recent_serial_error_count"] or 0
    out = []
    for r in rows:
        before = {"prev_fw_version": now["fw_version"], "prev_battery": now["battery"], "prev_event_time": now["last_event_time"]}
        for c in LAST:
            if r[c] is not None:
                now[c] = r[c]
        if r["plane"] == "serial":
            now["serial_category"] = r["serial_category"]
        if r["event_type"] == "serial.log" and r["serial_log_line"] is not None:
            now["last_serial_log_line"] = r["serial_log_line"]
        if now["device_name"] is None:
            now["device_name"] = r["device_name"]
        if r["severity"] == "ERROR":
            now["recent_serial_error_count"] += 1
        if r["plane"] == "telemetry" and r["event_time"] is not None:
            now["last_application_report_at"] = r["event_time"]
        now["last_event_time"] = r["event_time"]
        now["health_status"] = _status(r["plane"], *map(now.get, NUMBERS), r["severity"], *map(now.get, SIGNS)) or now["health_status"] or "unknown"
        out.append({**r, **{c: now[c] for c in AFTER}, **{f"eff_{c}": now[c] for c in (*LAST, "device_name")}, **before, "newest": False})
    out[-1]["newest"] = True
    return out, now


def device_rows(arrivals: DataFrame, trigger_names: Sequence[str] = ()) -> DataFrame:
    """Arrivals as the operator takes them; events of the given names trigger fetches."""
    named = F.col("event_name").isin(*trigger_names) if trigger_names else F.lit(False)
    return in_micros(arrivals.select(*ARRIVAL, named.alias("is_trigger"))).withColumn("kind", F.lit("arrival"))


def fetch_rows(classified: DataFrame) -> DataFrame:
    """Status fetches (classified, with project_id and trigger_event_id) as the operator takes them."""
    return classified.filter(F.col("ledger_name") == ledgers.STATUS_LEDGER).select(
        F.lit("fetch").alias("kind"), "project_id", F.col("scope_value").alias("device_id"), F.unix_micros("fetched_at").alias("received_at"),
        "outcome", F.col("http_status").cast("int").alias("http_status"), "trigger_event_id",
    )


def with_fetches(arrivals: DataFrame, failed: DataFrame | None) -> DataFrame:
    if failed is not None:
        return arrivals.unionByName(failed, allowMissingColumns=True)
    return arrivals.withColumns({"outcome": F.lit(None).cast("string"), "http_status": F.lit(None).cast("int"), "trigger_event_id": F.lit(None).cast("string")})


def folded_stream(rows: DataFrame, initial: DataFrame | None = None, triggers: bool = True) -> DataFrame:
    """``device_rows`` (and ``fetch_rows``) of a stream, each with the state after it. ``initial``: stored states to continue from."""
    if initial is not None:
        initial = in_micros(initial).select(*state.KEY, *struct(STATE).names)
    return keyed(rows, state.KEY, fold, STATE, state.ARRIVAL_ORDER, FOLDED, initial, TRIGGER if triggers else None)


def outputs(folded: DataFrame) -> DataFrame:
    """(output, state, item): the newest state of every device and all history items, row by row from what the operator returns."""
    rows = from_micros(folded, INSTANTS).withColumns({"anomalies": state.effective_anomalies(), "eff_category": F.struct(F.col("serial_category").alias("v"))})
    rows = rows.withColumn("found", history.found_items())
    none = F.get(F.col("found"), F.lit(-1))
    fetch = F.col("kind") == "fetch"
    made = F.when(fetch, F.array(F.struct(F.lit("item").alias("output"), none.alias("i")))).otherwise(F.concat(
        F.transform("found", lambda i: F.struct(F.lit("item").alias("output"), i.alias("i"))),
        F.when(F.col("newest"), F.array(F.struct(F.lit("state").alias("output"), none.alias("i")))).otherwise(F.array()),
    ))
    rows = rows.withColumn("_o", F.explode(made)).withColumns({"output": F.col("_o.output"), "i": F.col("_o.i")})
    failed = history.failure_columns(F.col("event_id"), F.coalesce("event_time", "received_at"), F.coalesce("event_time_text", iso(F.col("received_at"))))
    item = F.when(fetch, F.struct(*failed)).otherwise(F.struct(*history.item_columns()))
    return rows.select(
        "output", F.when(F.col("output") == "state", F.struct(*state.state_columns())).alias("state"), F.when(F.col("output") == "item", item).alias("item"),
    )


OUTPUTS = "outputs"


def state_table(spark: SparkSession, root: str) -> Versions:
    return Versions(spark, f"{root}/state", state.KEY, column="state", base=root)


def history_table(spark: SparkSession, root: str) -> Versions:
    """Items delivered again have the key of the stored ones and replace them."""
    return Versions(spark, f"{root}/history", ["device_id", "history_key"], column="item", base=root)


def write_outputs(folded: DataFrame, batch_id: int, root: str) -> None:
    """Both outputs of a batch by one job, then one more segment for each table."""
    spark, folder = folded.sparkSession, f"{OUTPUTS}/{batch_id:010d}-{uuid.uuid4().hex[:8]}"
    rows = outputs(folded).withColumn(BATCH, F.lit(batch_id))
    with settings(spark, TWO_FOLDERS):
        rows.write.partitionBy("output").parquet(f"{root}/{folder}", compression=CODEC)
    schema = rows.drop("output").schema.json()
    written = Files(spark, root).names(folder)
    for name, table in (("state", state_table(spark, root)), ("item", history_table(spark, root))):
        if f"output={name}" in written:
            table.adopt(f"{folder}/output={name}", batch_id, schema)


def start_fold(rows: DataFrame, root: str, initial: DataFrame | None = None, triggers: bool = True, **trigger) -> StreamingQuery:
    """Start the fold of a stream of ``device_rows``; tables and checkpoint lie under ``root``."""
    return (
        folded_stream(rows, initial, triggers).writeStream.option("checkpointLocation", f"{root}/_checkpoint-fold")
        .foreachBatch(lambda df, batch_id: write_outputs(df, batch_id, root))
        .outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )
