"""Micro-batches, replays and restarts of the streaming jobs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from fleetlake.operators import history, ledgers, state
from fleetlake.plans import inputs
from fleetlake.plans.catalog_stream import TAIL_COLUMNS, webhook_bodies
from fleetlake.sources import inventory, tables, webhook
from fleetlake.streaming import device, ingest, ledgers as ledger_stream, tail


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def parts(df, time):
    cut = F.lit("2024-01-15").cast("timestamp")
    return df.filter(F.col(time) < cut), df.filter(F.col(time) >= cut)


def landed(spark, rows, folder, **options):
    rows.write.mode("append").options(**options).json(folder)
    return spark.readStream.schema(rows.schema).json(folder)


def drained(query):
    query.awaitTermination()
    return query


# ---- state and history


def test_fold_in_batches_equals_one_pass(spark, tmp_path):
    root, arrivals = str(tmp_path / "store"), inputs.arrivals(spark, SF)
    rows = arrivals.select(*device.ARRIVAL, "event_name")
    for part in parts(rows, "received_at"):
        stream = landed(spark, part, str(tmp_path / "landing"))
        drained(device.start_fold(device.with_fetches(device.device_rows(stream), None), root, triggers=False, availableNow=True))
    assert same(device.state_table(spark, root).read().select(*state.STATE_COLUMNS), state.current_state(arrivals).select(*state.STATE_COLUMNS))
    whole = history.derive_history(state.state_history(arrivals))
    assert same(device.history_table(spark, root).read().select(*whole.columns), whole)
    # Delivered once more as a later batch: no key is stored twice.
    stream = landed(spark, parts(rows, "received_at")[1], str(tmp_path / "landing"))
    drained(device.start_fold(device.with_fetches(device.device_rows(stream), None), root, triggers=False, availableNow=True))
    stored = device.history_table(spark, root).read()
    assert stored.count() == stored.select("device_id", "history_key").distinct().count()


def test_failed_batch_runs_again_and_changes_nothing(spark, tmp_path, monkeypatch):
    """A batch that fails after its outputs are written starts from the state before it."""
    root, arrivals = str(tmp_path / "store"), inputs.arrivals(spark, SF)
    rows, write, failures = arrivals.select(*device.ARRIVAL, "event_name"), device.write_outputs, []

    def fails_once(df, batch_id, path):
        write(df, batch_id, path)
        if batch_id == 1 and not failures:
            failures.append(batch_id)
            raise RuntimeError("lost after writing")

    monkeypatch.setattr(device, "write_outputs", fails_once)
    for part in parts(rows, "received_at"):
        stream = landed(spark, part, str(tmp_path / "landing"))

        def run():
            drained(device.start_fold(device.with_fetches(device.device_rows(stream), None), root, triggers=False, availableNow=True))

        try:
            run()
        except Exception as e:
            assert "lost after writing" in str(e)
            run()
    assert failures == [1]
    assert same(device.state_table(spark, root).read().select(*state.STATE_COLUMNS), state.current_state(arrivals).select(*state.STATE_COLUMNS))
    whole = history.derive_history(state.state_history(arrivals))
    assert same(device.history_table(spark, root).read().select(*whole.columns), whole)


def test_stored_states_are_where_a_new_store_begins(spark, tmp_path):
    """A backlog is folded in batch, the stream continues from its states."""
    arrivals = inputs.arrivals(spark, SF)
    early, late = parts(arrivals, "received_at")
    root, initial = str(tmp_path / "store"), state.current_state(early)
    stream = landed(spark, late.select(*device.ARRIVAL, "event_name"), str(tmp_path / "landing"))
    drained(device.start_fold(device.with_fetches(device.device_rows(stream), None), root, initial, False, availableNow=True))
    touched = late.select(*state.KEY).distinct()
    want = state.current_state(arrivals).join(touched, state.KEY, "left_semi")
    assert same(device.state_table(spark, root).read().select(*state.STATE_COLUMNS), want.select(*state.STATE_COLUMNS))


def test_cost_of_a_batch_does_not_follow_the_saved_devices(spark, tmp_path):
    """Ten devices read and write the same keys of the state store over 300 and over 30,000 saved ones, and no stored row."""
    arrivals = inputs.arrivals(spark, SF).select(*device.ARRIVAL, "event_name")
    one = arrivals.limit(1).withColumn("received_at", F.lit("2024-06-01").cast("timestamp"))
    seen = []
    for saved in (300, 30_000):
        folder = tmp_path / str(saved)
        folded = state.current_state(arrivals.limit(1))
        initial = folded.crossJoin(spark.range(saved).withColumnRenamed("id", "n")).withColumn("device_id", F.col("n").cast("string")).drop("n")
        ten = one.crossJoin(spark.range(10).withColumnRenamed("id", "n")).withColumn("device_id", F.col("n").cast("string")).drop("n")
        for _ in range(2):
            stream = landed(spark, ten, str(folder / "landing"))
            query = drained(device.start_fold(device.with_fetches(device.device_rows(stream), None), str(folder / "store"), initial, False, availableNow=True))
        operator = query.lastProgress["stateOperators"][0]
        assert operator["numRowsTotal"] == saved
        seen.append((operator["numRowsUpdated"], operator["customMetrics"]["rocksdbPutCount"], operator["customMetrics"]["rocksdbGetCount"]))
    assert seen[0] == seen[1] and seen[0][0] == 10


def test_own_status_is_the_batch_rule(spark):
    values = list(itertools.product(
        ["serial", "telemetry", None], [None, 10.0, 25.0, 50.0], [None, 10.0, 200.0, 400.0], [None, 0.0, 1.0], [None, "ERROR", "WARN", "INFO"], [None, True], [None, False, True], [None, True]))
    names = ["plane", "battery", "connect_time", "alert_count", "severity", "watchdog", "reconnect", "reset"]
    kinds = "plane string, battery double, connect_time double, alert_count double, severity string, watchdog boolean, reconnect boolean, reset boolean"
    want = spark.createDataFrame(values, kinds).select(state.own_health(*map(F.col, names)).alias("s")).collect()
    columns = [np.array(c, object) for c in zip(*values)]
    assert device.own_status(*columns).tolist() == [r["s"] for r in want]


def test_fetch_finds_its_trigger_in_an_earlier_batch(spark, tmp_path):
    root, arrivals = str(tmp_path / "store"), inputs.arrivals(spark, SF)
    triggers = arrivals.filter(F.col("event_name") == "sensor-hook").limit(12)
    rows = triggers.select(*device.ARRIVAL, "event_name")
    answers = triggers.select(
        "project_id", F.col("device_id").alias("scope_value"), F.lit("device-status").alias("ledger_name"), (F.col("received_at") + F.expr("interval 1 minute")).alias("fetched_at"),
        F.col("event_id").alias("trigger_event_id"), F.when(F.col("event_id") < "8", 503).otherwise(404).alias("http_status"), F.lit("").alias("body"))
    stray = answers.limit(1).withColumn("trigger_event_id", F.lit("unheard"))
    arrived, fetched = str(tmp_path / "arrivals"), str(tmp_path / "fetched")
    for first, second in ((rows, answers.limit(0)), (rows.limit(0), answers.unionByName(stray))):
        events, fetches = landed(spark, first, arrived), landed(spark, second, fetched)
        stream = device.with_fetches(device.device_rows(events, ["sensor-hook"]), device.fetch_rows(ledgers.classify_fetches(fetches)))
        query = drained(device.start_fold(stream, root, availableNow=True))
    failed = device.history_table(spark, root).read().filter("event_type = 'LEDGER_SYNC_FAILED'")
    want = history.sync_failures(ledgers.classify_fetches(answers), F.lit(None).cast("string"), triggers)
    known = failed.filter(~F.col("history_key").contains("#no-event-id#"))
    assert same(known.select("device_id", "history_key", "report_time", "error_kind"), want.select("device_id", "history_key", "report_time", "error_kind"))
    assert failed.count() == want.count() + 1  # a fetch without a known trigger keeps its own time
    # What was answered is remembered no longer: one row per device is left.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == rows.select("device_id").distinct().count()


# ---- the other tables


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), ingest.Store(str(tmp_path / "store"))
    bad = spark.createDataFrame([("{broken", None), (None, None)], webhook.LANDING_SCHEMA).withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    for part in (*parts(webhook_bodies(spark, SF), "received_at"), bad):
        part.write.mode("append").option("ignoreNullFields", "false").json(landing)
        ingest.start_ingest(webhook.stream_landing(spark, landing), store, availableNow=True).awaitTermination()
    index = inputs.index(spark, SF)
    assert store.index(spark).count() == index.count()
    assert sorted(r.status for r in store.quarantine(spark).collect()) == ["invalid", "missing"]
    # One day is that day's files and needs no window.
    day = store.index(spark, ["2024-01-05"])
    assert same(day.select("event_id"), index.filter(F.to_date("event_time") == F.lit("2024-01-05")).select("event_id"))
    assert "Window" not in day._jdf.queryExecution().executedPlan().toString()
    assert {f.rsplit("/", 2)[1] for f in day.inputFiles()} == {"event_date=2024-01-05"}


def test_index_batch_rewrites_the_dates_it_touches(spark, tmp_path):
    store = ingest.Store(str(tmp_path / "store"))
    first, second = parts(webhook_bodies(spark, SF), "received_at")
    ingest.ingest_batch(first.unionByName(second), 0, store)
    before = {s.date: s.path for s in store.index_table(spark).segments()}
    rows = sorted(r.event_id for r in store.index(spark).collect())
    for batch in (1, 1, 2):  # a replay, and the same deliveries again
        ingest.ingest_batch(second.filter("received_at < '2024-01-17'"), batch, store)
    after = {s.date: s.path for s in store.index_table(spark).segments()}
    changed = {d for d in before if before[d] != after[d]}
    assert before.keys() == after.keys() and changed and changed <= {"2024-01-14", "2024-01-15", "2024-01-16", "2024-01-17"}
    assert sorted(r.event_id for r in store.index(spark).collect()) == rows


def test_tail_drops_late_and_repeated_events(spark, tmp_path):
    rows = inputs.index(spark, SF).select(*TAIL_COLUMNS)
    early, late = parts(rows, "event_time")
    out, landing = str(tmp_path / "tail"), str(tmp_path / "landing")
    for part in (late, rows.unionByName(rows), rows):
        drained(tail.start_tail(landed(spark, part, landing), out, availableNow=True))
    devices = late.select("device_id").distinct()
    expected = late.unionByName(early.join(devices, "device_id", "left_anti"))
    assert same(tables.read_batches(spark, out).select(*TAIL_COLUMNS), expected)


def test_bounded_tail_keeps_bounded_state(spark, tmp_path):
    """State holds what is younger than the watermark however many devices there were; late rows are counted."""
    out, landing = str(tmp_path / "tail"), str(tmp_path / "landing")
    start, held, dropped = 1_704_067_200, [], 0
    for hour in range(4):
        rows = spark.range(200).select(
            F.concat(F.lit(f"d{hour}-"), F.col("id").cast("string")).alias("device_id"), F.timestamp_seconds(F.lit(start + hour * 36_000) + F.col("id")).alias("event_time"), F.col("id").cast("string").alias("event_id"))
        late = rows.limit(3).withColumn("event_time", F.timestamp_seconds(F.lit(start - 360_000))) if hour == 3 else rows.limit(0)
        query = drained(tail.start_bounded_tail(landed(spark, rows.unionByName(rows).unionByName(late).coalesce(1), landing), out, availableNow=True))
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        dropped += sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    assert tables.read_batches(spark, out).count() == 800 and max(held) <= 400 and dropped >= 3


def test_older_snapshot_does_not_replace_a_newer_one(spark, tmp_path):
    path, landing = str(tmp_path / "ledgers"), str(tmp_path / "landing")
    fetches = inputs.ledger_fetches(spark, SF).withColumn("fetched_at", F.timestamp_micros(F.unix_micros("fetched_at") + 900_000_000_000_000))
    first, second = parts(fetches, "fetched_at")
    for part in (first, second):
        part.write.mode("append").json(landing)
        source = spark.readStream.schema(inventory.FETCH_SCHEMA).json(landing)
        drained(ledger_stream.start_projection(source, path, str(tmp_path / "checkpoint"), availableNow=True))
    whole = ledgers.stored_snapshots(ledgers.accept(ledgers.classify_fetches(fetches)))
    assert same(ledger_stream.stored(spark, path), whole)


def test_archive_layout(spark, tmp_path):
    from fleetlake.operators.archive import archive_records

    path = str(tmp_path / "archive")
    records = archive_records(inputs.arrivals(spark, SF))
    tables.write_archive(records, path)
    stored = spark.read.parquet(path)
    assert stored.count() == records.count()
    assert "PartitionFilters: [isnotnull(event_date" in stored.filter("event_date = '2024-01-05'")._jdf.queryExecution().executedPlan().toString()


def test_steps_take_rows_and_cost_little(spark):
    """Most keys have few rows in a batch: a step works on these rows alone, without a data frame for each key."""
    import time

    at = [{"scope_value": "1", "ledger_name": "device-status", "outcome": "ok", "updated_at": t} for t in (20, 10, None, 30)]
    out, saved = ledger_stream.judge(at, {"updated_at": 15})
    assert [r["effect"] for r in out] == ["updated", "stale", "missing_updated_at", "updated"] and saved == {"updated_at": 30}
    assert [r["newest"] for r in out] == [False, False, False, True]
    events = [{"event_time": t, "event_id": e} for t, e in ((None, "a"), (5, "a"), (5, "a"), (5, "b"), (7, "a"))]
    assert tail.after_cursor(events, {"event_time": 5, "event_id": "a"}) == (events[3:], events[4])
    assert tail.after_cursor(events, {"event_time": None, "event_id": "a"})[0] == [events[1], *events[3:]]
    assert tail.after_cursor(events[:1], {"event_time": 9, "event_id": "z"}) == ([], None)
    assert [r["before"] for r in tail.with_before(at[:2], None)[0]] == [None, 20]
    start = time.perf_counter()
    for _ in range(5_000):
        tail.after_cursor(events, None), ledger_stream.judge(at, None), tail.with_before(at[:2], None)
    assert time.perf_counter() - start < 2.5
