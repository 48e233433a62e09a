"""Stored tables are dealt by rows, so that a task's work and memory do not grow with the table."""

import datetime

import pytest

from fleetlake.operators.normalize import event_index
from fleetlake.plans import catalog_fleet, inputs

PARTS = 6


def _tables(spark, folder, devices=5, rows=60):
    """Small tables in one file each; events of a device share times, and some have none."""
    start = datetime.datetime(2024, 1, 1)
    events = [
        (n, start + datetime.timedelta(hours=n // 2) if n % 9 else None, n % devices, ("view", "click", "error", "purchase", "signup")[n % 5], n / 4, f'{{"k": {n % 90}}}')
        for n in range(rows)
    ]
    orders = [(n, n % devices, "P", 10.0 * n, start + datetime.timedelta(days=n), "1-URGENT") for n in range(rows)]
    customers = [(n, f"c{n}", n % 3, 1.0, "BUILDING") for n in range(rows)]
    for name, data, schema in (
        ("events", events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        ("customer", customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    ):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("built", [inputs.raw_events, inputs.ledger_fetches, inputs.inventory])
def test_tables_are_dealt_by_rows(spark, tmp_path, monkeypatch, built):
    sf_dir = _tables(spark, tmp_path)
    whole = _rows(built(spark, sf_dir))
    monkeypatch.setattr(inputs, "ROWS_PER_TASK", 10, raising=False)
    parts = built(spark, sf_dir)
    sizes = [n for n in parts.rdd.glom().map(len).collect() if n]
    assert len(sizes) == PARTS and max(sizes) <= 20
    assert _rows(parts) == whole and len(whole) == 60


def test_index_moves_rows_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "ROWS_PER_TASK", 10, raising=False)
    sf_dir = _tables(spark, tmp_path)
    built = inputs.index_from_arrivals(spark, sf_dir)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") == 1
    assert _rows(built) == _rows(event_index(inputs.arrivals(spark, sf_dir).drop("event_date")))


def test_overlay_reads_customers_in_parts(spark, tmp_path, monkeypatch):
    sf_dir, seen, leaves = _tables(spark, tmp_path), [], catalog_fleet.overlay.leaves
    whole = _rows(catalog_fleet.j8_overlay(spark, sf_dir))
    monkeypatch.setattr(inputs, "ROWS_PER_TASK", 10, raising=False)
    monkeypatch.setattr(catalog_fleet.overlay, "leaves", lambda docs, *a: (seen.append(docs.rdd.getNumPartitions()), leaves(docs, *a))[1])
    assert _rows(catalog_fleet.j8_overlay(spark, sf_dir)) == whole
    assert seen == [PARTS, PARTS]
