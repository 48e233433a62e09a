"""Devices above the slice limit: same results as the plain plan, the SQL twin and naive loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import check
from conftest import SF
from fleetlake.operators import sequence, state
from fleetlake.operators.ordered import first_known, last_known, plan_slices, previous, running_max, running_sum, scan

SLICED = [
    "w1_gaps", "w2_firmware_changes", "w5_anchored_windows", "w6_bursts", "w6_burst_events", "w7_current_state", "w8_health_carry_forward",
    "w9_serial_error_count", "w10_last_application_report", "w11_throttled_refresh", "j4_product_resolution", "j9_previous_state",
    "r2_device_anomalies", "r4_timeline_anomalies", "s6_history_append", "q8_timeline_analytics", "i1_modem_connectivity", "r7_window_assembly", "j5_ledger_upsert", "j6_stored_snapshots", "t5_snapshot_changes",
]


@pytest.fixture()
def tiny_slices(spark):
    spark.conf.set("fleetlake.rows.per.slice", "4")
    yield
    spark.conf.unset("fleetlake.rows.per.slice")


@pytest.mark.parametrize("name", SLICED)
def test_sliced_equals_sql_twin(spark, duckdb_tables, tiny_slices, name):
    assert check(spark, duckdb_tables, SF, name, entry.queries()[name], entry.oracle_sql()[name]) in ("", "no rows")


def random_events(seed, n, spread_seconds, devices=2, step_ms=1):
    """One device with most of the rows, and a small one; many equal times."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        device = "hot" if rng.random() < 0.9 else f"cold{rng.randrange(devices)}"
        at = start + timedelta(milliseconds=rng.randrange(spread_seconds * 1000 // step_ms) * step_ms)
        rows.append((device, at, f"e{i:05d}", rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(100))])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "device_id string, event_time timestamp, event_id string, event_name string, v double").withColumn(
        "received_at", F.col("event_time")
    )


def walk(times, width, min_size=1, closed=True):
    """Naive walk of one device: time -> anchor of its window."""
    labels, i = {}, 0
    while i < len(times):
        inside = [t for t in times[i:] if (t - times[i] <= width if closed else t - times[i] < width)]
        if len(inside) >= min_size:
            for t in inside:
                labels[t] = times[i]
            i += len(inside)
        else:
            i += 1
    return labels


@pytest.mark.parametrize("seed,n,spread,width,min_size,step", [
    (1, 400, 3600, 60, 1, 1), (2, 400, 3600, 60, 3, 1000), (3, 300, 300, 20, 1, 1000), (4, 300, 86400, 600, 3, 1),
    (5, 500, 2000, 100, 4, 500), (6, 200, 500, 50, 2, 10000),
])
@pytest.mark.parametrize("rows_per_slice", [None, 20, 60])
def test_windows_equal_the_loop(spark, seed, n, spread, width, min_size, step, rows_per_slice):
    rows = random_events(seed, n, spread, step_ms=step)
    events = frame(spark, rows)
    slices = rows_per_slice and plan_slices(events, ["device_id"], "event_time", rows_per_slice, bucket_seconds=2 * width)
    assert rows_per_slice is None or slices is not None
    got = {
        (r.device_id, r.event_id): r.window_start
        for r in sequence.burst_events(events, width / 60, min_size, slices).collect()
    }
    want = {}
    for device in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == device)
        labels = walk([t for t, _ in own], timedelta(seconds=width), min_size)
        want |= {(device, e): labels[t] for t, e in own if t in labels}
    assert got == want


def test_empty_slices_do_not_break_the_chain(spark):
    """Slices planned on all events, windows cut over a few of them."""
    events = frame(spark, random_events(21, 600, 86400))
    few = events.filter(F.col("event_id").rlike("[05]$") & (F.hour("event_time") % 5 < 2))
    slices = plan_slices(events, ["device_id"], "event_time", 10, bucket_seconds=1200)
    plain, sliced = (sequence.anchored_windows(few, 10, s).select("event_id", "window_start").collect() for s in (None, slices))
    assert sorted(plain) == sorted(sliced) and len(plain) > 20


@pytest.mark.parametrize("rows_per_slice", [None, 15])
def test_throttle_equals_the_loop(spark, rows_per_slice):
    rows = random_events(9, 300, 3000, step_ms=1000)
    events = frame(spark, rows)
    slices = rows_per_slice and plan_slices(events, ["device_id"], "received_at", rows_per_slice, bucket_seconds=120)
    got = sorted((r.device_id, r.event_id) for r in sequence.throttled(events, 60, slices=slices).collect())
    want = []
    for device in {r[0] for r in rows}:
        last = None
        for at, event_id in sorted((r[1], r[2]) for r in rows if r[0] == device):
            if last is None or at - last >= timedelta(seconds=60):
                want.append((device, event_id))
                last = at
    assert got == sorted(want)


def test_running_values_equal_the_loop(spark):
    rows = random_events(11, 500, 5000, step_ms=100)
    events = frame(spark, rows)
    slices = plan_slices(events, ["device_id"], "event_time", 25, bucket_seconds=30)
    assert slices.max_slices > 3
    outputs = {
        "prev": previous(F.col("event_name")), "last": last_known(F.col("v")), "before": last_known(F.col("v"), inclusive=False),
        "first": first_known(F.col("v")), "total": running_sum(F.coalesce("v", F.lit(0.0))), "top": running_max(F.col("v"), inclusive=False),
    }
    order = ["event_time", "event_id"]
    sliced = scan(events, ["device_id"], order, outputs, slices)
    got = {r.event_id: tuple(r[c] for c in outputs) for r in sliced.collect()}
    want = {}
    for device in {r[0] for r in rows}:
        name = last = first = top = None
        total = 0.0
        for _, _, event_id, own_name, v in sorted((r for r in rows if r[0] == device), key=lambda r: (r[1], r[2])):
            before = last
            last = v if v is not None else last
            first = first if first is not None else v
            total += v or 0.0
            want[event_id] = (name, last, before, first, total, top)
            name = own_name
            top = v if top is None else top if v is None else max(top, v)
    assert got == want


def test_small_devices_need_no_slices(spark):
    events = frame(spark, random_events(12, 50, 100))
    assert plan_slices(events, ["device_id"], "event_time", 1000) is None


def test_current_state_from_saved_state_equals_one_pass(spark):
    from fleetlake.plans import inputs

    rows = inputs.arrivals(spark, SF)
    cut = F.lit("2024-01-15").cast("timestamp")
    early, late = rows.filter(F.col("received_at") < cut), rows.filter(F.col("received_at") >= cut)
    saved = state.current_state(early)
    touched = late.select(*state.KEY).distinct()
    continued = state.current_state(late, stored=saved)
    whole = state.current_state(rows).join(touched, state.KEY, "left_semi")
    assert continued.exceptAll(whole).count() == 0 and whole.exceptAll(continued).count() == 0


# ---- one device with most rows inside one bucket


def dense_events(seed, n, spread_seconds, within_seconds):
    """Nine tenths of all rows are one device's, and nine tenths of those fall within a short time."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        device = "hot" if rng.random() < 0.9 else f"cold{rng.randrange(2)}"
        burst = device == "hot" and rng.random() < 0.9
        at = start + timedelta(milliseconds=spread_seconds * 500 + rng.randrange(within_seconds * 1000) if burst else rng.randrange(spread_seconds * 1000))
        rows.append((device, at, f"e{i:05d}", rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(100))])))
    return rows


@pytest.mark.parametrize("within,bucket", [(59, 60), (3600, 86_400)])  # one minute, and one day cut by the day
def test_dense_bucket_is_cut_inside(spark, within, bucket):
    limit = 25
    rows = dense_events(31, 900, 86_000, within)
    events = frame(spark, rows)
    slices = plan_slices(events, ["device_id"], "event_time", limit, bucket_seconds=bucket)
    assert slices.dense is not None
    order = ["event_time", "event_id"]
    sizes = slices.cut_inside(slices.assign(events), order).filter("_slice >= 0").groupBy("device_id", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * limit
    outputs = {"prev": previous(F.col("event_name")), "last": last_known(F.col("v")), "total": running_sum(F.coalesce("v", F.lit(0.0))), "top": running_max(F.col("v"))}
    sliced, plain = (sorted(scan(events, ["device_id"], order, outputs, s).collect(), key=str) for s in (slices, None))
    assert sliced == plain and len(plain) == 900


@pytest.mark.parametrize("width,min_size", [(1, 1), (600, 1), (600, 3), (20, 4), (20_000, 2)])
def test_windows_over_many_dense_slices_equal_the_loop(spark, width, min_size):
    """Windows shorter than a slice, and windows that cover many slices."""
    rows = dense_events(32, 700, 86_000, 59)
    events = frame(spark, rows)
    slices = plan_slices(events, ["device_id"], "event_time", 25, bucket_seconds=60)
    got = {(r.device_id, r.event_id): r.window_start for r in sequence.burst_events(events, width / 60, min_size, slices).collect()}
    want = {}
    for device in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == device)
        labels = walk([t for t, _ in own], timedelta(seconds=width), min_size)
        want |= {(device, e): labels[t] for t, e in own if t in labels}
    assert got == want
