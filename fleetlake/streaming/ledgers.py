"""Continuous ledger projection with stale-write protection.

Each scope's ledger keeps the time of its stored snapshot in the state store; a fetch is judged against it, so a batch reads no stored row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlake.operators import ledgers
from fleetlake.sources.versions import Versions
from fleetlake.streaming.keyed import Memory, from_micros, in_micros, keyed

FETCH = [*ledgers.FETCH_KEY, *ledgers.FETCH_ORDER, "outcome", "updated_at", "size_bytes", "data"]
JUDGED = "scope_value string, ledger_name string, fetched_at long, seq long, updated_at long, size_bytes long, data string, effect string, newest boolean"


def table(spark: SparkSession, path: str) -> Versions:
    return Versions(spark, path, ledgers.FETCH_KEY)


def stored(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Stored snapshots, optionally as of the batches before one."""
    return table(spark, path).read(before)


def judge(rows: list[dict], saved: dict | None, memory: Memory | None = None) -> tuple[list[dict], dict]:
    """What each fetch of one ledger does, in fetch order: the rule of ``ledgers.accept``, continued from the stored snapshot's time."""
    before, effects = saved["updated_at"] if saved else None, []
    for r in rows:
        outcome, updated_at, ledger = r["outcome"], r["updated_at"], r["ledger_name"]
        if ledger == ledgers.SETTINGS_LEDGER and outcome == "missing_ledger":
            before = None
            effects.append("cleared")
        elif outcome != "ok":
            effects.append("failed")
        elif updated_at is None:
            effects.append("missing_updated_at")
        elif before is None or updated_at > before:
            before = updated_at
            effects.append("updated")
        else:
            effects.append("stale")
    kept = [i for i, e in enumerate(effects) if e in ("updated", "cleared")]
    return [{**r, "effect": e, "newest": i in kept[-1:]} for i, (r, e) in enumerate(zip(rows, effects))], {"updated_at": before}


def judged(fetches: DataFrame) -> DataFrame:
    """Every fetch of a stream with its effect; ``newest`` marks what a batch leaves stored."""
    rows = in_micros(ledgers.classify_fetches(fetches).select(*FETCH)).withColumn("seq", F.col("seq").cast("long"))
    return from_micros(keyed(rows, ledgers.FETCH_KEY, judge, "updated_at long", ledgers.FETCH_ORDER, JUDGED), ["fetched_at", "updated_at"])


def store_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Adds the snapshots that this batch changes; older or equal ones leave the stored row alone."""
    changed = rows.filter("newest").select(*ledgers.FETCH_KEY, "updated_at", "fetched_at", "size_bytes", "data")
    table(rows.sparkSession, path).commit(changed, batch_id)


def start_projection(fetches: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        judged(fetches).writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: store_batch(df, batch_id, path))
        .outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )
