"""Running values over the ordered events of a device, safe for devices of any size.

A plain ``Window.partitionBy(device)`` puts one device in one task. ``plan_slices`` counts rows per
device first; a device above the limit is cut into consecutive time slices, every slice is its own
window partition, and what crosses a slice border (last value, running sum, ...) is carried over by
a table with one row per slice. Slices are cut at bucket borders; a bucket that alone holds far more rows than the limit is
cut inside, at places of the full order. Devices below the limit keep the plain window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlake.session import cut_lineage

AUTO = "auto"  # large keys are looked for where the operator runs
ROWS_PER_SLICE = 500_000
BROADCAST_ROWS = 200_000
SLICE = "_slice"
COLD = -1
INSIDE = 1_000_000  # slices inside a slice at most


@dataclass(frozen=True)
class Slices:
    """Bucket to slice map of the large keys (columns: key..., _bucket, _slice)."""

    table: DataFrame
    key: tuple[str, ...]
    time: str
    bucket_micros: int
    buckets: int
    max_slices: int
    rows: int = ROWS_PER_SLICE
    dense: DataFrame | None = None  # slices (key..., _slice) with more than twice the rows, which one bucket holds

    def _small(self, df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the slice number; rows of ordinary devices get ``COLD``."""
        bucket = bucket_of(F.col(self.time), self.bucket_micros)
        return (
            df.withColumn("_bucket", bucket)
            .join(self._small(self.table, self.buckets), [*self.key, "_bucket"], "left")
            .withColumn(SLICE, F.coalesce(F.col(SLICE), F.lit(COLD)))
            .drop("_bucket")
        )

    def covering(self, df: DataFrame) -> Slices:
        """The same slices for rows of the large keys whose buckets held none before: they belong to the slice that goes before them."""
        of_bucket = [*self.key, "_bucket"]
        buckets = df.select(*self.key, bucket_of(F.col(self.time), self.bucket_micros).alias("_bucket"), F.lit(None).cast("int").alias(SLICE)).distinct()
        all_ = self.table.select(*of_bucket, SLICE).unionByName(buckets).groupBy(*of_bucket).agg(F.max(SLICE).alias(SLICE))
        up_to = Window.partitionBy(*self.key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        table = cut_lineage(all_.withColumn(SLICE, F.last(SLICE, ignorenulls=True).over(up_to)))
        return replace(self, table=table, buckets=table.count())

    def cut_inside(self, sliced: DataFrame, order: list[str]) -> DataFrame:
        """Number the slices anew, with the dense ones cut at places of the order; rows that are equal in all of it stay together.

        One range partitioning of the dense rows finds places that leave about half the limit between them; one row per dense slice has them.
        """
        if self.dense is None:
            return sliced
        of_slice = [*self.key, SLICE]
        crowded = sliced.join(F.broadcast(self.dense), of_slice, "left_semi").select(*of_slice, *[o for o in order if o not in of_slice])
        total = crowded.count()
        parts = max(1, math.ceil(2 * total / self.rows))
        dealt = crowded.repartitionByRange(parts, *of_slice, *order).withColumn("_part", F.spark_partition_id())
        firsts = dealt.groupBy(*of_slice, "_part").agg(F.min(F.struct(*order)).alias("first"))
        cuts = cut_lineage(firsts.groupBy(*of_slice).agg(F.sort_array(F.collect_list("first")).alias("_cuts")))
        place = F.size(F.filter(F.col("_cuts"), lambda c: c <= F.struct(*order)))
        numbered = F.when(F.col(SLICE) == COLD, F.lit(COLD).cast("bigint")).otherwise(F.col(SLICE).cast("bigint") * INSIDE + F.coalesce(place, F.lit(0)))
        return sliced.join(F.broadcast(cuts), of_slice, "left").withColumn(SLICE, numbered).drop("_cuts")

    def per_slice(self, df: DataFrame) -> DataFrame:
        """Hint for a table with one row per slice."""
        return self._small(df, self.buckets)


def bucket_of(time: Column, micros: int) -> Column:
    """Bucket number; rows without a time sort first, so they belong to the lowest bucket."""
    return F.coalesce(F.floor(F.unix_micros(time) / F.lit(micros)).cast("bigint"), F.lit(-(2**62)))


def plan_slices(
    df: DataFrame, key: list[str], time: str, rows_per_slice: int = ROWS_PER_SLICE, bucket_seconds: int = 60
) -> Slices | None:
    """Find the keys with more than ``rows_per_slice`` rows and cut them at bucket borders.

    Returns None when there is no such key, the usual case. Costs one count per key over the key column.
    """
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    large = counts.filter(F.col("_n") > rows_per_slice)
    n_large = large.count()
    if n_large == 0:
        return None
    large = large.select(*key)
    if n_large <= BROADCAST_ROWS:
        large = F.broadcast(large)
    micros = bucket_seconds * 1_000_000
    per_bucket = (
        df.join(large, key, "left_semi")
        .groupBy(*key, bucket_of(F.col(time), micros).alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    by_bucket = Window.partitionBy(*key).orderBy("_bucket")
    before = F.sum("_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1))
    share = F.floor(F.coalesce(before, F.lit(0)) / F.lit(rows_per_slice))
    consecutive = F.dense_rank().over(Window.partitionBy(*key).orderBy("_share")) - 1
    counted = cut_lineage(
        per_bucket.withColumn("_share", share).select(*key, "_bucket", consecutive.alias(SLICE), "_n")
    )
    buckets, top = counted.agg(F.count(F.lit(1)), F.max(SLICE)).first()
    dense = counted.groupBy(*key, SLICE).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > 2 * rows_per_slice).select(*key, SLICE)
    crowded = dense.limit(1).count() > 0
    return Slices(counted.drop("_n"), tuple(key), time, micros, buckets, top + 1, rows_per_slice, dense if crowded else None)


def resolved(slices: Slices | str | None, df: DataFrame, key: list[str], time: str, bucket_seconds: int = 60) -> Slices | None:
    """``AUTO`` looks for large keys; given slices are kept, cut anew where their buckets are too narrow; None is the plain window."""
    if slices is None or isinstance(slices, Slices) and slices.bucket_micros >= bucket_seconds * 1_000_000:
        return slices
    rows = ROWS_PER_SLICE if slices == AUTO else slices.rows
    return plan_slices(df.select(*key, time), key, time, rows, bucket_seconds)


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is previous, last, first, sum or max."""

    kind: str
    value: Column
    inclusive: bool = True


def previous(value: Column) -> Running:
    return Running("previous", value, False)


def last_known(value: Column, inclusive: bool = True) -> Running:
    return Running("last", value, inclusive)


def first_known(value: Column, inclusive: bool = True) -> Running:
    return Running("first", value, inclusive)


def running_sum(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def scan(
    df: DataFrame, key: list[str], order: list[str], outputs: dict[str, Running], slices: Slices | str | None = AUTO
) -> DataFrame:
    """Add one column per running value, ordered by ``order`` inside every key."""
    slices = resolved(slices, df, key, order[0])
    names = list(outputs)
    inputs = {n: f"_in_{n}" for n in names}
    df = df.withColumns({inputs[n]: F.struct(r.value.alias("v")) if r.kind == "previous" else r.value for n, r in outputs.items()})
    if slices is None:
        local = _windowed(df, key, order, outputs, inputs)
        done = {n: F.col(f"_local_{n}.v") if outputs[n].kind == "previous" else F.col(f"_local_{n}") for n in names}
        return local.withColumns(done).drop(*inputs.values(), *[f"_local_{n}" for n in names])

    sliced = slices.cut_inside(slices.assign(df), order)
    local = _windowed(sliced, [*key, SLICE], order, outputs, inputs)
    carried = _carry(sliced.filter(F.col(SLICE) != COLD), key, order, outputs, inputs)
    joined = local.join(slices.per_slice(carried), [*key, SLICE], "left")
    return joined.withColumns({n: _combine(outputs[n], n) for n in names}).drop(
        SLICE, *inputs.values(), *[f"_local_{n}" for n in names], *[f"_carry_{n}" for n in names]
    )


def _windowed(df, key, order, outputs, inputs) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cols = {}
    for n, r in outputs.items():
        c, frame = F.col(inputs[n]), up_to if r.inclusive else before
        cols[f"_local_{n}"] = {
            "previous": lambda: F.lag(c).over(w),
            "last": lambda: F.last(c, ignorenulls=True).over(frame),
            "first": lambda: F.first(c, ignorenulls=True).over(frame),
            "sum": lambda: F.sum(c).over(frame),
            "max": lambda: F.max(c).over(frame),
        }[r.kind]()
    return df.withColumns(cols)


def _carry(hot: DataFrame, key, order, outputs, inputs) -> DataFrame:
    """Per slice: the value accumulated over all earlier slices of the key."""
    position = F.struct(*order)
    totals = []
    for n, r in outputs.items():
        c = F.col(inputs[n])
        seen = F.when(c.isNotNull(), position)
        totals.append({
            "previous": lambda: F.max_by(c, position),
            "last": lambda: F.max_by(c, seen),
            "first": lambda: F.min_by(c, seen),
            "sum": lambda: F.sum(c),
            "max": lambda: F.max(c),
        }[r.kind]().alias(f"_slice_{n}"))
    per_slice = hot.groupBy(*key, SLICE).agg(*totals)
    earlier = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for n, r in outputs.items():
        c = F.col(f"_slice_{n}")
        carried.append({
            "previous": lambda: F.last(c, ignorenulls=True),
            "last": lambda: F.last(c, ignorenulls=True),
            "first": lambda: F.first(c, ignorenulls=True),
            "sum": lambda: F.sum(c),
            "max": lambda: F.max(c),
        }[r.kind]().over(earlier).alias(f"_carry_{n}"))
    return per_slice.select(*key, SLICE, *carried)


def _combine(r: Running, name: str) -> Column:
    local, carry = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
    if r.kind == "previous":
        return F.coalesce(local, carry)["v"]
    if r.kind == "last":
        return F.coalesce(local, carry)
    if r.kind == "first":
        return F.coalesce(carry, local)
    if r.kind == "sum":
        return F.when(local.isNotNull() | carry.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    return F.greatest(local, carry)


def newest(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """Top ``n`` rows per key. Spark trims every key to n rows before the shuffle, so a hot key stays small."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
