"""Windows anchored at their first event: each starts at the first event after the previous one ended.

The next anchor depends on the previous one, so the choice is sequential per device. Only distinct event
times take part. An ordinary device is folded in one pass over its sorted times. A large device is cut
into time slices, however short: every slice tells for each place where a walk may enter it after which time the walk goes on; these times are
looked up among the slices, pointer doubling finds the entry of every slice, the slices name their anchors in parallel, and a running
value carries the last anchor to all times, over as many slices as a window covers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fleetlake.operators.ordered import AUTO, COLD, SLICE, Slices, last_known, newest, resolved, scan
from fleetlake.session import cut_lineage

NO_WINDOW = -(2**63)


def window_labels(
    events: DataFrame, key: list[str], time: str, width_micros: int, min_size: int = 1, slices: Slices | str | None = AUTO
) -> DataFrame:
    """(key, t, anchor) for every distinct time inside a window, times in microseconds.

    A window opens at an uncovered time with at least ``min_size`` rows in [t, t + width] and covers that range.
    """
    rows = events.filter(F.col(time).isNotNull())
    slices = resolved(slices, rows, key, time)
    if slices is None:
        return _fold(rows.select(*key, F.unix_micros(time).alias("t")), key, width_micros, min_size)
    sliced = slices.assign(rows).select(*key, SLICE, F.unix_micros(time).alias("t"))
    cold = _fold(sliced.filter(F.col(SLICE) == COLD).select(*key, "t"), key, width_micros, min_size)
    return cold.unionByName(_sliced(sliced.filter(F.col(SLICE) != COLD), key, width_micros, min_size, slices))


def _walk(opens: np.ndarray, following: np.ndarray, entry: int, stop: int) -> np.ndarray:
    """Position of the window each time belongs to, -1 outside; jumps from window to window."""
    anchor = np.full(len(opens), -1)
    candidates, pos = np.flatnonzero(opens[:stop]), entry
    while pos < stop:
        at = np.searchsorted(candidates, pos)
        if at == len(candidates):
            break
        first = candidates[at]
        pos = int(following[first])
        anchor[first:pos] = first
    return anchor


def _fold(times: DataFrame, key: list[str], width: int, min_size: int) -> DataFrame:
    """One walk over the sorted times of each device; a batch hands many devices to one call."""

    def anchors_of(times: np.ndarray) -> np.ndarray:
        t = np.asarray(times)
        following = np.searchsorted(t, t + width, side="right")
        anchor = _walk(following - np.arange(len(t)) >= min_size, following, 0, len(t))
        repeated = np.concatenate([[False], t[1:] == t[:-1]])
        return np.where((anchor < 0) | repeated, NO_WINDOW, t[anchor])

    @F.pandas_udf("array<bigint>")
    def anchors(times: pd.Series) -> pd.Series:
        return times.map(anchors_of)

    return (
        times.groupBy(*key).agg(F.sort_array(F.collect_list("t")).alias("times"))
        .withColumn("anchors", anchors("times"))
        .select(*key, F.explode(F.arrays_zip(F.col("times").alias("t"), F.col("anchors").alias("anchor"))).alias("l"))
        .select(*key, "l.t", "l.anchor").filter(F.col("anchor") != NO_WINDOW)
    )


def _sliced(rows: DataFrame, key: list[str], width: int, min_size: int, slices: Slices) -> DataFrame:
    time = slices.time
    counted = rows.groupBy(*key, SLICE, "t").agg(F.count(F.lit(1)).alias("n")).withColumn(time, F.timestamp_micros("t"))
    numbered = cut_lineage(slices.cut_inside(counted, ["t"]))
    # Slices are numbered over those that hold times: a filtered input may leave some of them empty.
    firsts = numbered.groupBy(*key, SLICE).agg(F.min("t").alias("first"))
    borders = cut_lineage(firsts.withColumn("s", F.dense_rank().over(Window.partitionBy(*key).orderBy(SLICE)) - 1))
    own = numbered.join(slices.per_slice(borders), [*key, SLICE]).select(*key, "s", "t", "n", time, F.lit(False).alias("halo"))
    points = own.drop(time)
    if min_size > 1:
        # The times that decide whether a window opens at the last places of a slice; a following slice may have one time only.
        heads = newest(points, [*key, "s"], [F.col("t").asc()], min_size - 1)
        back = F.explode(F.sequence(F.lit(1), F.lit(min_size - 1)))
        points = points.unionByName(heads.withColumn("_back", back).withColumn("s", F.col("s") - F.col("_back")).drop("_back").withColumn("halo", F.lit(True)))

    key_types = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in key)

    def ordered(pdf: pd.DataFrame):
        """Own times, whether a window opens there, and the first own place that is not covered then."""
        pdf = pdf.sort_values("t")
        every, m = pdf["t"].to_numpy(), int((~pdf["halo"]).sum())
        total = np.concatenate([[0], np.cumsum(pdf["n"].to_numpy())])
        t = every[:m]
        opens = total[np.searchsorted(every, t + width, side="right")] - total[:m] >= min_size
        return t, opens, np.where(opens, np.searchsorted(t, t + width, side="right"), np.arange(1, m + 1))

    def rows_of(pdf: pd.DataFrame, **columns) -> pd.DataFrame:
        """Rows of one slice; without any the columns keep their types."""
        n = len(next(iter(columns.values())))
        return pd.DataFrame({**{k: pd.Series([pdf[k].iloc[0]] * n, dtype=pdf[k].dtype) for k in key}, **columns})

    def hops(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each place of entry the time after which the walk goes on beyond the slice."""
        if pdf["halo"].all():
            return rows_of(pdf, s=np.zeros(0, int), i=np.zeros(0, int), y=np.zeros(0, int))
        t, opens, following = ordered(pdf)
        m = len(t)
        last = np.where(following < m, following, np.arange(m))
        while (further := last[last] != last).any():
            last = np.where(further, last[last], last)
        entries = np.arange(min(m, int(np.searchsorted(t, t[0] + width, side="right")) + 1))
        leave = last[entries]
        return rows_of(pdf, s=np.full(len(entries), pdf["s"].iloc[0]), i=entries, y=t[leave] + np.where(opens[leave], width, 0))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        """Where in its slice each time that is asked for is passed."""
        asked = pdf["asks"].to_numpy(dtype=bool)
        t, y = np.sort(pdf["t"].to_numpy()[~asked]), pdf["t"].to_numpy()[asked]
        at = np.searchsorted(t, y, side="right")
        return rows_of(pdf, y=y, s2=int(pdf["s"].iloc[0]) + (at == len(t)), i2=np.where(at == len(t), 0, at))

    def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        t, opens, following = ordered(pdf)
        anchor = _walk(opens, following, int(pdf["entry"].iloc[0]), len(t))
        found = np.unique(anchor[anchor >= 0])
        return rows_of(pdf, t=t[found])

    edges = cut_lineage(points.groupBy(*key, "s").applyInPandas(hops, f"{key_types}, s int, i bigint, y bigint"))
    # The slice that holds each of these times, then the place in it.
    marks = borders.select(*key, F.timestamp_micros("first").alias(time), F.lit(0).alias("_asks"), "s", F.lit(None).cast("bigint").alias("y"))
    asks = edges.select(*key, "y").distinct().select(*key, F.timestamp_micros("y").alias(time), F.lit(1).alias("_asks"), F.lit(None).cast("int").alias("s"), "y")
    held = scan(marks.unionByName(asks), key, [time, "_asks"], {"_held": last_known(F.col("s"))}, slices.covering(asks)).filter("_asks = 1")
    asked = held.select(*key, F.col("_held").alias("s"), F.col("y").alias("t"), F.lit(True).alias("asks"))
    lookup = own.select(*key, "s", "t", F.lit(False).alias("asks")).unionByName(asked)
    places = lookup.groupBy(*key, "s").applyInPandas(place, f"{key_types}, y bigint, s2 int, i2 bigint")
    jump = cut_lineage(edges.join(places, [*key, "y"]).select(*key, "s", "i", "s2", "i2"))
    reached = jump.filter("s = 0 and i = 0").select(*key, "s", "i")
    most = borders.agg(F.max("s")).first()[0] or 0
    for _ in range(max(1, math.ceil(math.log2(most + 2)))):
        step = reached.join(jump, [*key, "s", "i"]).select(*key, F.col("s2").alias("s"), F.col("i2").alias("i"))
        reached = cut_lineage(reached.unionByName(step))
        onward = jump.select(*key, F.col("s").alias("s2"), F.col("i").alias("i2"), F.col("s2").alias("s3"), F.col("i2").alias("i3"))
        jump = cut_lineage(
            jump.join(onward, [*key, "s2", "i2"]).select(*key, "s", "i", F.col("s3").alias("s2"), F.col("i3").alias("i2"))
        )
    entry = reached.select(*key, "s", F.col("i").alias("entry"))
    opened = points.join(slices.per_slice(entry), [*key, "s"]).groupBy(*key, "s").applyInPandas(anchors, f"{key_types}, t bigint")
    marked = own.join(opened.withColumn("anchor", F.col("t")), [*key, "t"], "left")
    labelled = scan(marked.select(*key, time, "t", "anchor"), key, [time], {"_last": last_known(F.col("anchor"))}, slices)
    return labelled.filter(F.col("t") <= F.col("_last") + width).select(*key, "t", F.col("_last").alias("anchor"))


def label_events(
    events: DataFrame, key: list[str], time: str, width_micros: int, min_size: int = 1, slices: Slices | str | None = AUTO
) -> DataFrame:
    """Events inside a window with its ``window_start``; events outside every window are left out."""
    labels = window_labels(events, key, time, width_micros, min_size, slices)
    return (
        events.withColumn("t", F.unix_micros(time)).join(labels, [*key, "t"])
        .withColumn("window_start", F.timestamp_micros("anchor")).drop("t", "anchor")
    )
