"""The immutable raw archive and its join with events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlake.functions.payload import analytics_payload, field_exact, json_object
from fleetlake.functions.values import prefix_number
from fleetlake.operators.ordered import newest

# Metric column and the case-sensitive fields analytics reads it from.
PAYLOAD_METRICS = {
    "battery": ["battery"], "connect_time": ["connecttime"], "reset_count": ["resets"], "alert_count": ["alerts"],
    "occupancy": ["occupancy"], "daily_occupancy": ["dailyoccupancy"], "temperature": ["temp", "temperature"],
}


def archive_records(arrivals: DataFrame, details: dict[str, Column] | None = None) -> DataFrame:
    """One archive object per arrival: the payload as received, keyed and dated. ``details``: further columns, read from the arrival."""
    return arrivals.select(
        "archive_key", F.substring("event_time_text", 1, 10).alias("event_date"), "device_id", "event_name",
        F.col("event_time_text").alias("published_at"), "received_at", "data", "data_type",
        F.col("legacy_fw_version").alias("fw_version"), "body_fields",
        *[c.alias(name) for name, c in (details or {}).items()],
    )


def objects(archive: DataFrame) -> DataFrame:
    """The archive as its readers see it: of deliveries that share a key the last received replaces the others."""
    return newest(archive, ["archive_key"], [F.col("received_at").desc(), F.col("data").desc()])


def payload_columns(data: Column, body: Column) -> tuple[Column, dict[str, Column]]:
    """The fields of a payload by the analytics rule, and the metrics read from them."""
    content = F.coalesce(json_object(data), analytics_payload(data))

    def metric(fields: list[str]) -> Column:
        return F.coalesce(*[prefix_number(field_exact(F.col("content"), body, f)) for f in fields])

    return content, {m: metric(fields) for m, fields in PAYLOAD_METRICS.items()}


def payloads(archive: DataFrame) -> DataFrame:
    """What the object of every archive key says: numbers and the few fields of status reports, not the text.

    Written once by ``tables.write_payloads``, so that neither the last-received rule nor the reading is repeated by each question.
    """
    content, metrics = payload_columns(F.col("data"), F.col("body_fields"))
    name = F.lower("event_name")
    return objects(archive).withColumn("content", content).select(
        "archive_key", F.lit(True).alias("has_payload"), F.col("fw_version").alias("archived_fw_version"),
        F.when(name.contains("status") | name.contains("state"), F.col("content")).alias("content"),
        *[c.alias(f"archived_{m}") for m, c in metrics.items()],
        *[F.col(c).alias(f"archived_{c}") for c in ("reset_cause", "details", "message") if c in archive.columns],
    )


def with_payload(events: DataFrame, archive: DataFrame) -> DataFrame:
    """Events with what their payload says; events whose object is missing keep nulls, none has more than one.

    ``archive`` are stored ``payloads`` or archive records, which are read here. Payloads stored in buckets of the archive key stay
    where they are; only the events move.
    """
    stored = archive if "has_payload" in archive.columns else payloads(archive)
    return events.join(stored, "archive_key", "left").withColumn("has_payload", F.coalesce("has_payload", F.lit(False)))


def payload_metrics(joined: DataFrame) -> DataFrame:
    """The metrics of the archived payload in place of the indexed ones."""
    return joined.withColumns({m: F.col(f"archived_{m}") for m in PAYLOAD_METRICS})
