"""What the ingest stream keeps on disk: compressed files, no drafts, no shuffle files of what has ended."""

import datetime
import pathlib

from fleetlake.plans import catalog_stream, inputs
from fleetlake.sources import versions, webhook
from fleetlake.streaming import ingest

START = datetime.datetime(2024, 1, 1)


def shuffles(spark) -> set:
    return set(spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().keySet().mkString(",").split(","))


def files(folder) -> list[str]:
    return [str(p) for p in pathlib.Path(str(folder).removeprefix("file:")).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]


def test_stream_leaves_compressed_files_only(spark, tmp_path):
    events = [(n, START + datetime.timedelta(hours=5 * n), n % 5, ("view", "click", "error", "view")[n % 4], n / 4, f'{{"k": {n}}}') for n in range(120)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    cleaned, held = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffles(spark)
    before = spark.conf.get(cleaned, None)
    store = catalog_stream.ingested(spark, str(tmp_path))
    assert not shuffles(spark) - held and spark.conf.get(cleaned, None) in (before, "false")
    for name in ("landing", "fetched"):
        landed = files(catalog_stream._folder(spark, str(tmp_path), name))
        assert landed and all(f.endswith(".json.gz") for f in landed)
    for name in ("index", "archive", "quarantine", "outputs"):
        stored = [f for f in files(store.table(name)) if f.endswith(".parquet")]
        assert all(f.endswith(".zstd.parquet") for f in stored) and (stored or name == "quarantine")
    assert not files(store.table(ingest.DRAFTS))
    assert store.index(spark).count() == inputs.index(spark, str(tmp_path)).count() > 100
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.allowFAllocate") == "false"


def test_rejected_bodies_stay_as_received(spark, tmp_path):
    texts = ['{"event": "a", "coreid": "1", "published_at": "2024-01-01T00:00:00Z", "data": "{\\"battery\\": 5}"}', "{broken", None, "[1]", " ", '{"a": 1} tail', "null"]
    landed = spark.createDataFrame([(t, START) for t in texts], webhook.LANDING_SCHEMA)
    store = ingest.Store(str(tmp_path / "store"))
    for _ in range(2):  # a replay
        ingest.ingest_batch(landed, 0, store)
    assert sorted((r.status, r.body) for r in store.quarantine(spark).filter("body is not null").collect()) == [("invalid", t) for t in sorted(["{broken", "[1]", '{"a": 1} tail', "null"])]
    assert [r.status for r in store.quarantine(spark).filter("body is null").collect()] == ["missing"]
    assert sorted((r.event_name, r.battery) for r in store.index(spark).collect()) == [("a", 5.0), ("unknown", None)]
    assert store.archive(spark).count() == 2 and not files(store.table(ingest.DRAFTS))


def test_key_that_came_often_is_combined_first(spark, tmp_path, monkeypatch):
    """Rows are the same, by one shuffle of all rows or by one of what is left of each key."""
    def body(n, device, minute):
        return f'{{"event": "a", "coreid": "{device}", "published_at": "2024-01-0{1 + minute // 60}T00:{minute % 60:02}:00Z", "data": "{{\\"battery\\": {n}}}"}}'

    bodies = [(body(n, n % 3, 7 * (n % 17)), START + datetime.timedelta(seconds=n % 50)) for n in range(200)] + [(body(n, 1, 5), START) for n in range(60)]
    first, second = (spark.createDataFrame(b, webhook.LANDING_SCHEMA).repartition(4) for b in (bodies[:150], bodies[150:]))
    found, combined = [], []
    for many in (versions.MANY, 20):
        monkeypatch.setattr(versions, "MANY", many)
        monkeypatch.setattr(ingest, "event_index", lambda rows, dealt=(), f=ingest.event_index: (combined.append((many, bool(dealt))), f(rows, dealt))[1])
        store = ingest.Store(str(tmp_path / str(many)))
        for batch, part in enumerate((first, second)):
            ingest.ingest_batch(part, batch, store)
        found.append([(r.device_id, r.event_time_text, r.received_at, r.event_id) for r in store.index(spark).orderBy("device_id", "event_time_text").collect()])
        monkeypatch.undo()
    assert found[0] == found[1] and len(found[0]) == len(set(r[:2] for r in found[0])) == 52
    assert combined == [(10_000, True)] * 2 + [(20, True), (20, False), (20, True)]
