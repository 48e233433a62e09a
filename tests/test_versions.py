"""Versioned tables: newest rows, replays, merging, and calls that do not grow with the batches."""

import random

from pyspark.sql import functions as F

from fleetlake.sources.versions import FAN, SMALL, Versions, size_class, to_merge


def table(spark, path, **options):
    return Versions(spark, str(path), ["k"], **options)


def put(spark, t, batch, **rows):
    t.commit(spark.createDataFrame(list(rows.items()), "k string, v int").coalesce(1), batch)


def read(t, before=None):
    rows = t.read(before)
    return None if rows is None else sorted(tuple(r) for r in rows.collect())


def test_newest_rows_and_earlier_versions(spark, tmp_path):
    t = table(spark, tmp_path / "t", fan=2)
    put(spark, t, 0, a=1, b=1)
    put(spark, t, 1, a=2)
    put(spark, t, 2, c=3)
    put(spark, t, 2, c=4)  # runs again
    assert read(t) == [("a", 2), ("b", 1), ("c", 4)]
    assert read(t, 2) == [("a", 2), ("b", 1)] and read(t, 1) == [("a", 1), ("b", 1)] and read(t, 0) is None


def test_rows_below_a_column(spark, tmp_path):
    t = table(spark, tmp_path / "t", fan=2, column="state")
    put(spark, t, 0, a=1)
    put(spark, t, 1, a=2, b=3)
    assert read(t) == [("a", 2), ("b", 3)] and len(t.segments()) == 1


def test_reader_sees_one_version_while_segments_are_merged(spark, tmp_path):
    t = table(spark, tmp_path / "t", fan=3)
    for i in range(2):
        put(spark, t, i, **{f"k{i}": i, "same": i})
    rows = t.read()
    for i in range(2, 8):
        put(spark, t, i, **{f"k{i}": i, "same": i})
    assert sorted(map(tuple, rows.collect())) == [("k0", 0), ("k1", 1), ("same", 1)]
    assert dict(read(t))["same"] == 7 and len(t.segments()) < 4


def test_calls_and_files_of_late_batches_equal_early_ones(spark, tmp_path):
    """Each batch lists and reads what is live; calls, live segments and folders do not follow the number of batches."""
    t, calls, live = table(spark, tmp_path / "t", kept=3), [], []
    for i in range(48):
        before = t.files.calls
        put(spark, t, i, **{f"k{i % 5}": i})
        calls.append(t.files.calls - before)
        live.append(len(t.segments()))
        t.files.calls -= 2  # of segments()
    assert max(calls[24:]) == max(calls[12:24]) and max(live) <= FAN
    assert len(list((tmp_path / "t").iterdir())) <= FAN + 2 * (3 + FAN)
    assert read(t) == [(f"k{i}", max(j for j in range(48) if j % 5 == i)) for i in range(5)]


def test_size_classes_stay_few_over_ten_thousand_batches():
    rng, most, written = random.Random(1), [], 0
    for cap in (400 * SMALL, None):  # updates of the same keys, and new keys only
        live, seen = [], {}
        for batch in range(10_000):
            live.append(rng.randrange(1, 2 * SMALL))
            merge = to_merge(live)
            if merge:
                size = sum(live[i] for i in merge)
                live = [s for i, s in enumerate(live) if i not in merge] + [size if cap is None else min(cap, size)]
                written += size
            seen[len(str(batch))] = max(seen.get(len(str(batch)), 0), len(live))
        most.append(seen)
    assert most[0][4] <= most[0][3] + FAN and most[1][4] <= 2 * most[1][3]


def test_to_merge():
    assert to_merge([10] * (FAN - 1)) == [] and to_merge([10] * FAN) == list(range(FAN))
    assert size_class(SMALL) == 0 and size_class(SMALL + 1) == 1 and size_class(SMALL * FAN * 2) == 2
    full = [SMALL * 2] * (FAN - 1) + [SMALL // 2] * FAN  # what is merged fills the next class
    assert to_merge(full) == list(range(2 * FAN - 1))
    assert to_merge([SMALL * 100] + [1] * FAN) == list(range(1, FAN + 1))
