"""The archive of the registered queries: its rows follow the deliveries, and only what evidence reads is written."""

import datetime

from pyspark.sql import functions as F

from fleetlake.operators import correlate
from fleetlake.plans import inputs
from fleetlake.plans.device import correlation

COPIES = 12


def _events(spark, folder):
    """Eight events of four devices, each delivered COPIES times under ids of their own."""
    start = datetime.datetime(2024, 1, 1)
    kinds = ("view", "click", "error", "purchase")
    rows = [(8 * c + n, start + datetime.timedelta(hours=n), n % 4, kinds[n % 4], 61.5, f'{{"k": {n}}}') for c in range(COPIES) for n in range(8)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_archive_has_one_row_per_delivery(spark, tmp_path):
    sf_dir = _events(spark, tmp_path)
    there = inputs.arrivals(spark, sf_dir).filter(~F.col("event_id").startswith("0"))
    archive = inputs.reported_archive(spark, sf_dir)
    keys = lambda df: sorted(map(tuple, df.groupBy("archive_key").count().collect()))
    assert keys(archive) == keys(there) and max(n for _, n in keys(archive)) > 1
    named = {r.archive_key: (r.event_name, int(r.event_id[0], 16)) for r in there.collect()}
    for r in archive.collect():
        name, n = named[r.archive_key]
        wd = name == "watchdog-v2"
        assert (r.reset_cause, r.details, r.message) == (f"cause-{n}" if wd and n % 2 == 0 else None, "stack" if wd and n % 3 == 0 else None, "timer expired" if wd else None)


def test_reused_members_hold_what_is_read(spark, tmp_path):
    sf_dir = _events(spark, tmp_path)
    index, archive = inputs.index(spark, sf_dir), inputs.reported_archive(spark, sf_dir)
    whole = correlation(index, archive, 360)
    kept = correlation(index, archive, 360, reused=True)
    assert kept[0].columns == correlate.MEMBER
    lines = [sorted(map(repr, correlate.evidence(members, found).collect())) for members, _, found in (whole, kept)]
    assert lines[0] == lines[1]
    assert sorted(map(repr, whole[1].collect())) == sorted(map(repr, kept[1].collect()))
