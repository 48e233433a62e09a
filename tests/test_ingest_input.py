"""What the streams read is parsed once, and only where it is needed."""

import datetime

from pyspark.sql import functions as F

from fleetlake.functions.payload import json_object
from fleetlake.plans import catalog_fleet


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_json_object_parses_a_text_once(spark):
    texts = ['{"a": 1, "b": null}', "{}", " {\"a\":\"x\"} ", '{"a": 1}, {"b": 2}', '{"a": 1} tail}', "[1]", "null", "", None, '{"a": {"c": [1]}}', "{a: 1}"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string").repartition(2)
    read = rows.select("n", json_object(F.col("text")).alias("o"))
    assert _plan(read).count("from_json") == 1
    got = {r.n: r.o for r in read.collect()}
    assert got == {0: {"a": "1", "b": None}, 1: {}, 2: {"a": "x"}, 9: {"a": '{"c":[1]}'}} | dict.fromkeys((3, 4, 5, 6, 7, 8, 10))


def test_landed_fetches_read_no_payload(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events = [(n, start + datetime.timedelta(hours=n // 3) if n % 9 else None, n % 5, ("view", "click", "error", "view")[n % 4], n / 4, f'{{"k": {n}}}') for n in range(80)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    landed = catalog_fleet.landed_fetches(spark, str(tmp_path))
    assert "from_json" not in _plan(landed)
    stored = catalog_fleet.triggered_fetches(spark, str(tmp_path))[1]
    assert sorted(map(repr, landed.collect())) == sorted(map(repr, stored.collect())) and landed.count() == 40
