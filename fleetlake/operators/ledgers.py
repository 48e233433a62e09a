"""Ledger snapshot fetches: outcome, acceptance order, stored snapshot and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlake.functions.payload import json_object
from fleetlake.functions.values import NUMBER, blank_to_null
from fleetlake.operators.ordered import AUTO, Slices, last_known, newest, previous, resolved, running_max, running_sum, scan

SETTINGS_LEDGER = "device-settings"
STATUS_LEDGER = "device-status"
DATA_LEDGER = "device-data"
# How changes of a ledger are shown.
SNAPSHOT_KINDS = {STATUS_LEDGER: "RUNTIME", DATA_LEDGER: "DATA"}
# Http status classes of a failed fetch.
AUTH_STATUS = [401, 403]
MISSING_STATUS = [404]
RETRYABLE_STATUS = [408, 429, 500, 502, 503, 504]
FETCH_KEY = ["scope_value", "ledger_name"]
FETCH_ORDER = ["fetched_at", "seq"]


def json_at(document: Column, path: str) -> Column:
    """Variant at a path: null when absent, a variant null when the document has an explicit null."""
    return F.try_variant_get(document, f"$.{path}", "variant")


def json_shape(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(json_shape(value).startswith("OBJECT"), F.lit(False))


def json_number(value: Column) -> Column:
    """A JSON number; text that looks like one does not count."""
    return F.when(F.left(json_shape(value), F.lit(3)).isin("BIG", "DOU", "FLO", "DEC"), F.try_variant_get(value, "$", "double"))


def json_text(value: Column) -> Column:
    """Trimmed, non-empty JSON text."""
    return F.when(json_shape(value) == "STRING", blank_to_null(F.try_variant_get(value, "$", "string")))


def number_or_text(value: Column) -> Column:
    """A JSON number or numeric text."""
    text = json_text(value)
    return F.coalesce(json_number(value), F.when(text.rlike(NUMBER), text.try_cast("double")))


def classify_fetches(fetches: DataFrame) -> DataFrame:
    """Outcome of every fetch with the instance fields of the good ones."""
    status, body = F.col("http_status"), F.col("body")
    opened = fetches.withColumn("_m", json_object(body)).withColumn("_i", json_object(F.try_element_at("_m", F.lit("instance"))))
    instance = opened.withColumn("_d", F.try_element_at("_i", F.lit("data")))
    outcome = (
        F.when(status.isNull(), "network_failure")
        .when(status.isin(AUTH_STATUS), "auth_failure").when(status.isin(MISSING_STATUS), "missing_ledger")
        .when(status.isin(RETRYABLE_STATUS), "retryable_failure").when(~status.between(200, 299), "permanent_failure")
        .when(F.trim(F.coalesce(body, F.lit(""))) == "", "malformed_json")
        .when(F.col("_m").isNull() & F.try_parse_json(body).isNull(), "malformed_json")
        .when(json_object(F.col("_d")).isNull(), "permanent_failure")
        .otherwise("ok")
    )
    ok = F.col("outcome") == "ok"
    return instance.withColumn("outcome", outcome).withColumns({
        "retryable": F.col("outcome").isin("retryable_failure", "network_failure"),
        "data": F.when(ok, F.col("_d")),
        "updated_at": F.when(ok, F.try_element_at("_i", F.lit("updated_at")).try_cast("timestamp")),
        "size_bytes": F.when(ok, F.try_element_at("_i", F.lit("size_bytes")).try_cast("bigint")),
    }).drop("_m", "_i", "_d", "body")


def accept(fetches: DataFrame, slices: Slices | str | None = AUTO, stored: DataFrame | None = None) -> DataFrame:
    """What every classified fetch does to the stored snapshot, in fetch order.

    ``updated`` only when strictly newer than the stored one, else ``stale``. A missing settings ledger
    clears the stored snapshot (``cleared``), after which any snapshot is newer. ``stored`` continues from
    saved snapshots.
    """
    slices = resolved(slices, fetches, FETCH_KEY, FETCH_ORDER[0])
    clears = (F.col("ledger_name") == SETTINGS_LEDGER) & (F.col("outcome") == "missing_ledger")
    snapshot = (F.col("outcome") == "ok") & F.col("updated_at").isNotNull()
    marked = scan(fetches.withColumn("clears", clears), FETCH_KEY, FETCH_ORDER,
                  {"era": running_sum(F.when(clears, 1).otherwise(0).cast("bigint"))}, slices)
    seen = scan(marked, [*FETCH_KEY, "era"], FETCH_ORDER,
                {"newest_before": running_max(F.when(snapshot, F.col("updated_at")), inclusive=False)}, slices)
    if stored is not None:
        # The saved snapshot counts until the first clearing fetch of this batch.
        saved = stored.select(*FETCH_KEY, F.col("updated_at").alias("_saved"))
        seen = seen.join(saved, FETCH_KEY, "left").withColumn(
            "newest_before", F.greatest("newest_before", F.when(F.col("era") == 0, F.col("_saved")))
        ).drop("_saved")
    effect = (
        F.when(F.col("clears"), "cleared")
        .when(F.col("outcome") != "ok", "failed")
        .when(F.col("updated_at").isNull(), "missing_updated_at")
        .when(F.col("newest_before").isNull() | (F.col("updated_at") > F.col("newest_before")), "updated")
        .otherwise("stale")
    )
    return seen.withColumn("effect", effect).drop("clears", "era", "newest_before")


def stored_snapshots(accepted: DataFrame) -> DataFrame:
    """Latest accepted snapshot per scope and ledger; a cleared one keeps only its fetch time."""
    last = newest(accepted.filter(F.col("effect").isin("updated", "cleared")), FETCH_KEY, [F.col(c).desc() for c in FETCH_ORDER])
    return last.select(*FETCH_KEY, "updated_at", "fetched_at", "size_bytes", "data")


def reset_projection(accepted: DataFrame) -> DataFrame:
    """Reset counts of version 2 status snapshots; the older count stays when a newer snapshot has none."""
    rows = accepted.filter((F.col("effect") == "updated") & (F.col("ledger_name") == STATUS_LEDGER)).withColumn("_v", F.try_parse_json("data"))
    version2 = number_or_text(json_at(F.col("_v"), "schemaVersion")) == 2
    counts = rows.filter(version2).select(
        "scope_value", *FETCH_ORDER,
        number_or_text(json_at(F.col("_v"), "firmware.resetCount")).alias("firmware"),
        number_or_text(json_at(F.col("_v"), "startup.resetCount")).alias("startup"),
    )

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(*FETCH_ORDER)))

    return counts.groupBy("scope_value").agg(
        latest("firmware").alias("firmware_reset_count"), latest("startup").alias("startup_reset_count")
    ).filter(F.coalesce("firmware_reset_count", "startup_reset_count").isNotNull())


def sync_failures(accepted: DataFrame) -> DataFrame:
    """Failed fetches of the status ledger."""
    return accepted.filter((F.col("ledger_name") == STATUS_LEDGER) & (F.col("outcome") != "ok"))


def resolve_product(arrivals: DataFrame, lookup: DataFrame, slices: Slices | str | None = AUTO) -> DataFrame:
    """Product id of every arrival: its own, the last one known for the device, then the lookup table."""
    known = scan(arrivals, ["device_id"], ["received_at", "event_time", "event_id"],
                 {"_known": last_known(blank_to_null(F.col("product_id")))}, slices)
    table = lookup.select("device_id", blank_to_null(F.col("product_id")).alias("_lookup"))
    return known.join(table, "device_id", "left").withColumn("resolved_product_id", F.coalesce("_known", "_lookup")).drop("_known", "_lookup")


def refresh_eligible(resolved: DataFrame, event_names: list[str], devices: list[str], products: list[str]) -> DataFrame:
    """Arrivals that may trigger a refresh: listed event name, and listed device or product."""
    return resolved.filter(
        F.col("event_name").isin(event_names) & (F.col("device_id").isin(devices) | F.coalesce(F.col("resolved_product_id").isin(products), F.lit(False)))
    )


def snapshot_kind(ledger: Column) -> Column:
    return F.when(ledger == STATUS_LEDGER, SNAPSHOT_KINDS[STATUS_LEDGER]).when(ledger == DATA_LEDGER, SNAPSHOT_KINDS[DATA_LEDGER])


def changed_snapshots(seen: DataFrame) -> DataFrame:
    """A row for every first seen or changed snapshot time, from rows with the time ``before``."""
    return seen.filter(F.col("before").isNull() | (F.col("before") != F.col("updated_at"))).select(
        F.col("scope_value").alias("device_id"), snapshot_kind(F.col("ledger_name")).alias("kind"), F.col("updated_at").alias("time"),
        F.concat("ledger_name", F.lit(" snapshot "), F.when(F.col("before").isNull(), "available").otherwise("updated")).alias("summary"),
    )


def snapshot_changes(accepted: DataFrame, slices: Slices | str | None = AUTO) -> DataFrame:
    """Changes of the status and data ledgers."""
    rows = accepted.filter((F.col("effect") == "updated") & F.col("ledger_name").isin(*SNAPSHOT_KINDS))
    return changed_snapshots(scan(rows, FETCH_KEY, FETCH_ORDER, {"before": previous(F.col("updated_at"))}, slices))
