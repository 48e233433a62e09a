"""Sparse device history derived from consecutive states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlake.functions.values import number_text
from fleetlake.operators.state import offline_candidate

HISTORY_COLUMNS = [
    "device_id", "history_key", "event_type", "report_time", "anomalies", "anomaly_count",
    "from_fw_version", "to_fw_version", "battery_level", "error_kind", "http_status",
]
ANOMALY_TYPE = "array<struct<severity:string,type:string,message:string>>"


def history_key(time_text: Column, kind: Column, event_id: Column, content: Column) -> Column:
    """time#type#event#hash; the hash covers a canonical text of payload and item, so a replay gives the same key."""
    digest = F.substring(F.sha2(content, 256), 1, 32)
    return F.concat_ws("#", time_text, kind, F.coalesce(event_id, F.lit("no-event-id")), digest)


def canonical(fields: dict[str, Column]) -> Column:
    """``name=value`` pairs in name order; absent values are left out."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), fields[k].cast("string")) for k in sorted(fields)])


def found_items() -> Column:
    """What a folded row says, as an array: ANOMALY, FIRMWARE_UPDATE, BATTERY_CRITICAL and DEVICE_RECOVERED."""
    fw, prev_fw = F.col("fw_version"), F.col("prev_fw_version")
    battery, prev_battery = F.col("eff_battery"), F.col("prev_battery")
    t, prev_t = F.col("event_time"), F.col("prev_event_time")
    no_anomalies = F.lit(None).cast(ANOMALY_TYPE)
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def item(kind: str, anomalies=no_anomalies, old=no_text, new=no_text, level=no_number) -> Column:
        return F.struct(
            F.lit(kind).alias("event_type"), anomalies.alias("anomalies"), F.size(anomalies).alias("anomaly_count"),
            old.alias("from_fw_version"), new.alias("to_fw_version"), level.alias("battery_level"),
        )

    recovered = (
        (t > prev_t) & offline_candidate(prev_t, t) & ~offline_candidate(t, F.col("received_at"))
    )
    return F.array_compact(F.array(
        F.when(F.size("anomalies") > 0, item("ANOMALY", anomalies=F.col("anomalies"))),
        F.when((fw != "") & (prev_fw != "") & (fw != prev_fw), item("FIRMWARE_UPDATE", old=prev_fw, new=fw)),
        F.when((battery < 20) & ~F.coalesce(prev_battery < 20, F.lit(False)), item("BATTERY_CRITICAL", level=battery)),
        F.when(recovered, item("DEVICE_RECOVERED")),
    ))


def item_columns() -> list[Column]:
    """The history row of one found item (column ``i``) of a folded row.

    The payload enters the key by its digest, so the fold does not have to shuffle payload texts.
    """
    content = canonical({
        "payload": F.col("payload_digest"),
        "anomalies": F.array_join(F.transform("i.anomalies", lambda a: a["type"]), ","),
        "fromFwVersion": F.col("i.from_fw_version"), "toFwVersion": F.col("i.to_fw_version"),
        "batteryLevel": number_text(F.col("i.battery_level")),
    })
    return [
        F.col("device_id"),
        history_key(F.col("event_time_text"), F.col("i.event_type"), F.col("event_id"), content).alias("history_key"),
        F.col("i.event_type"), F.col("event_time").alias("report_time"),
        F.col("i.anomalies"), F.when(F.col("i.anomalies").isNotNull(), F.col("i.anomaly_count")).alias("anomaly_count"),
        F.col("i.from_fw_version"), F.col("i.to_fw_version"), F.col("i.battery_level"),
        F.lit(None).cast("string").alias("error_kind"), F.lit(None).cast("int").alias("http_status"),
    ]


def derive_history(states: DataFrame) -> DataFrame:
    """ANOMALY, FIRMWARE_UPDATE, BATTERY_CRITICAL and DEVICE_RECOVERED rows. Row-local on the folded states."""
    rows = states.select("device_id", "event_time", "event_time_text", "event_id", "payload_digest", F.explode(found_items()).alias("i"))
    return rows.select(*item_columns())


def sync_failures(failures: DataFrame, time_text: Column, triggers: DataFrame | None = None) -> DataFrame:
    """LEDGER_SYNC_FAILED rows for failed device-status fetches (columns of classified fetches).

    With ``triggers`` (arrivals) a failure takes time and id of the arrival that caused the fetch, whose event id the
    fetch carries as ``trigger_event_id``; without a trigger it keeps its own time.
    """
    named = failures if "trigger_event_id" in failures.columns else failures.withColumn("trigger_event_id", F.lit(None).cast("string"))
    rows = named.select(F.col("scope_value").alias("device_id"), "fetched_at", "outcome", "http_status", time_text.alias("_text"), "trigger_event_id")
    if triggers is None:
        event_id, time, text = F.lit(None).cast("string"), F.col("fetched_at"), F.col("_text")
    else:
        # A delivery that came twice is one trigger.
        cause = triggers.select("event_id", "event_time", "event_time_text").dropDuplicates(["event_id"])
        rows = rows.join(cause, F.col("trigger_event_id") == F.col("event_id"), "left")
        event_id, time, text = F.col("event_id"), F.coalesce("event_time", "fetched_at"), F.coalesce("event_time_text", "_text")
    return rows.select(*failure_columns(event_id, time, text))


def failure_columns(event_id: Column, time: Column, text: Column) -> list[Column]:
    """The history row of a failed fetch (columns device_id, outcome, http_status)."""
    kind, status = F.col("outcome"), F.col("http_status")
    content = canonical({"errorKind": kind, "httpStatus": status})
    return [
        F.col("device_id"), history_key(text, F.lit("LEDGER_SYNC_FAILED"), event_id, content).alias("history_key"),
        F.lit("LEDGER_SYNC_FAILED").alias("event_type"), time.alias("report_time"),
        F.lit(None).cast(ANOMALY_TYPE).alias("anomalies"), F.lit(None).cast("int").alias("anomaly_count"),
        F.lit(None).cast("string").alias("from_fw_version"), F.lit(None).cast("string").alias("to_fw_version"),
        F.lit(None).cast("double").alias("battery_level"),
        kind.alias("error_kind"), status.alias("http_status"),
    ]


def append_new(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming history rows whose key is not stored yet; replays append nothing."""
    return incoming.dropDuplicates(["device_id", "history_key"]).join(
        stored.select("device_id", "history_key"), ["device_id", "history_key"], "left_anti"
    )
