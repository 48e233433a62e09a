"""Tails: events after a per-device cursor, snapshot changes after a per-ledger one, and a tail of bounded state.

Cursors lie in the state store; what a batch passes on is written under its batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from fleetlake.operators.ledgers import FETCH_KEY, FETCH_ORDER, changed_snapshots
from fleetlake.sources import tables
from fleetlake.streaming.keyed import Memory, from_micros, in_micros, keyed, place

POSITION = ["event_time", "event_id"]


def after_cursor(rows: list[dict], saved: dict | None, memory: Memory | None = None) -> tuple[list[dict], dict | None]:
    """The events of one device after its cursor, once each and in order; an event without a time comes before all others."""
    fresh, last = [], place(saved, POSITION) if saved else None
    for r in rows:
        at = place(r, POSITION)
        if last is None or at > last:
            fresh.append(r)
            last = at
    return fresh, {c: fresh[-1][c] for c in POSITION} if fresh else None


def _keyed(rows: DataFrame, key: list[str], step, state: str, order: list[str], schema: StructType) -> DataFrame:
    """``keyed`` for steps that return columns of the rows; instants come back as such."""
    instants = [f.name for f in schema if isinstance(f.dataType, TimestampType)]
    sent = StructType([StructField(f.name, f.dataType if f.name not in instants else LongType()) for f in schema])
    return from_micros(keyed(in_micros(rows), key, step, state, order, sent), instants)


def start_tail(events: DataFrame, out: str, **trigger) -> StreamingQuery:
    """Continuous tail (device_id, event_time, event_id and any other columns); late events (behind the cursor) are dropped."""
    fresh = _keyed(events, ["device_id"], after_cursor, "event_time long, event_id string", POSITION, events.schema)
    return (
        fresh.writeStream.option("checkpointLocation", f"{out}-checkpoint")
        .foreachBatch(lambda df, batch_id: tables.write_batch(df.sortWithinPartitions(*POSITION), out, batch_id))
        .outputMode("append").trigger(**(trigger or {"processingTime": "3 seconds"})).start()
    )


def bounded_tail(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Every event once, by built-in operators: state is kept for ``late`` behind the newest event time, whatever the number of devices.

    Events later than that are dropped and counted by the query's progress (``numRowsDroppedByWatermark``), copies within it too.
    """
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["device_id", "event_time", "event_id"])


def start_bounded_tail(events: DataFrame, out: str, late: str = "1 hour", **trigger) -> StreamingQuery:
    return (
        bounded_tail(events, late).writeStream.option("checkpointLocation", f"{out}-checkpoint")
        .foreachBatch(lambda df, batch_id: tables.write_batch(df.sortWithinPartitions(*POSITION), out, batch_id))
        .outputMode("append").trigger(**(trigger or {"processingTime": "3 seconds"})).start()
    )


def with_before(rows: list[dict], saved: dict | None, memory: Memory | None = None) -> tuple[list[dict], dict]:
    """The snapshots of one ledger with the time of the one before."""
    times = [r["updated_at"] for r in rows]
    before = [saved["updated_at"] if saved else None, *times[:-1]]
    return [{**r, "before": b} for r, b in zip(rows, before)], {"updated_at": times[-1]}


def start_snapshot_tail(accepted: DataFrame, out: str, **trigger) -> StreamingQuery:
    """Continuous snapshot changes from accepted snapshots (scope_value, ledger_name, updated_at, fetched_at, seq)."""
    rows = accepted.filter(F.col("updated_at").isNotNull())
    schema = StructType([*rows.schema.fields, StructField("before", TimestampType())])
    seen = _keyed(rows, FETCH_KEY, with_before, "updated_at long", FETCH_ORDER, schema)
    return (
        changed_snapshots(seen).writeStream.option("checkpointLocation", f"{out}-checkpoint")
        .foreachBatch(lambda df, batch_id: tables.write_batch(df, out, batch_id))
        .outputMode("append").trigger(**(trigger or {"processingTime": "3 seconds"})).start()
    )
