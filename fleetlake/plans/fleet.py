"""The fleet report as one set of blocks over shared per-device rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlake.operators import fleet


def fleet_report(
    inventory: DataFrame, states: DataFrame, snapshots: DataFrame, configuration: DataFrame, product_id: str, as_of: str,
    allowance: float = fleet.TRANSPORT_ALLOWANCE_SECONDS, activity_limit: int | None = fleet.ACTIVITY_LIMIT,
) -> dict[str, DataFrame]:
    """Blocks of the report. The per-device rows are kept for all of them; unpersist ``devices`` when done."""
    members = fleet.fleet_devices(inventory, states, product_id)
    rows = fleet.report_rows(fleet.with_ledgers(members, snapshots, configuration), as_of, allowance).persist()
    device_data = bool(rows.agg(F.max("has_device_data")).first()[0])
    return {
        "devices": rows,
        "coverage": fleet.coverage(rows),
        "firmware": fleet.distribution(rows, "firmware_version"),
        "device_os": fleet.distribution(rows, "device_os_version"),
        "charge": fleet.charge_overview(rows),
        "attention": fleet.attention(rows, as_of, device_data),
        "activity": fleet.recent_activity(rows, activity_limit),
    }
