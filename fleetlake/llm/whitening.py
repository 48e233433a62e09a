"""Embedding whitening by refined eigenvectors of a distributed covariance.

Entries become integers x = floor(64*c) + 1000000, so every sum here is exact.
 1. Per-dimension sums S of the n vectors. The centre c0 is S/n rounded, z = x - c0.
 2. Tasks multiply centred blocks, z'z, small enough that float64 holds every product sum exactly, and add them up as integers; Spark adds
    the tasks' sums by matrix row. n^2 V = n * sum(z'z) - s s' with s = S - n*c0 holds exactly, so V has no rounding but its last one.
 3. ``refined``: eigenvectors of V in float32, then Ogita-Aishima iterations, matrix products alone, in float64 and at last in
    extended precision. Eigenvalues nearer to each other than the iteration can tell make a cluster: its part of V, shifted by the cluster's mean, is
    solved for itself and rotates the cluster's vectors.
 4. A pass over the vectors whitens them; the moments of what it returns, measured in one more pass, give the identity error.

What reaches the driver is d x d numbers, d the dimension, as one row per matrix row (d of 1,000: 8 MB); each task holds as much. No row is shuffled.

Defined results: vectors that are null, empty or hold null or non-finite entries are left out, and so are those of another than the commonest dimension. Rows that
occur twice count twice; a null key stays null. Components whose eigenvalue is zero to double precision cannot be scaled and
are left out, so one vector alone, or copies of one, give no rows, and neither does an empty table. Entries of 2^53/64 and
more in magnitude are no exact integers in double and raise an error. Only the named columns are read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm.common import session
from fleetlake.llm.vectors import sized

COMPONENTS = 32
LARGEST = float(1 << 53)
EXACT = 1 << 53


def integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """x of every vector of a batch, as int64."""
    flat = np.asarray(batch.column("v").flatten(), np.float64).reshape(-1, d)
    x = np.floor(64 * flat)
    if (np.abs(x) >= LARGEST).any():
        raise OverflowError("an entry is too large for an exact integer")
    return x.astype(np.int64) + 1_000_000


def column_sums(rows: DataFrame, d: int) -> list[int]:
    """S, exactly."""

    def run(batches):
        total = np.zeros(d, object)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # 512 times 2^53 fit
                total += integers(batch.slice(at, 512), d).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "s"])

    found = {r["i"]: int(r["s"]) for r in rows.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).toLocalIterator()}
    return [found[i] for i in range(d)]


def summed(partial: DataFrame, d: int, kind: str) -> list[list]:
    """Entrywise sums of the tasks' matrices, which come as rows (i, row)."""
    cells = partial.select("i", F.posexplode("row").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").cast(kind).alias("c"))
    rows = {r["i"]: r["row"] for r in cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "c"))).alias("row")).toLocalIterator()}
    return [[c["c"] for c in rows[i]] for i in range(d)]


def centred_products(rows: DataFrame, d: int, centre: list[int]) -> np.ndarray:
    """sum(z'z), exactly, as Python integers."""

    def run(batches):
        total, c0 = np.zeros((d, d), object), np.array(centre, np.int64)
        held, count, bound = np.zeros((d, d)), 0, 0
        for batch in batches:
            z = integers(batch, d) - c0
            largest = int(np.abs(z).max(initial=0)) ** 2
            step = max(1, EXACT // max(1, largest) // 2)
            for at in range(0, len(z), min(step, 4096)):
                part = z[at : at + min(step, 4096)]
                if largest * 2 > EXACT:  # one product alone may not fit
                    total += part.astype(object).T @ part.astype(object)
                    continue
                if bound + largest * len(part) > EXACT:
                    total += held.astype(np.int64).astype(object)
                    held, bound = np.zeros((d, d)), 0
                held += part.T.astype(np.float64) @ part.astype(np.float64)
                bound += largest * len(part)
            count += len(z)
        total += held.astype(np.int64).astype(object)
        if count:
            lists = pa.array([[Decimal(int(c)) for c in row] for row in total], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), lists], ["i", "row"])

    return np.array([[int(c) for c in row] for row in summed(rows.mapInArrow(run, "i int, row array<decimal(38,0)>"), d, "decimal(38,0)")], object)


def extended(values: np.ndarray) -> np.ndarray:
    """Python integers as extended-precision numbers, rounded once."""
    return np.array([np.longdouble(str(int(v))) for v in values.reshape(-1)], np.longdouble).reshape(values.shape)


def norm(a: np.ndarray) -> float:
    return float(np.abs(a.astype(np.float64)).sum(axis=1).max(initial=0))


def refined(v: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of a symmetric extended-precision matrix, falling."""
    d = len(v)
    scale = norm(v)
    if not scale:
        return np.zeros(d), np.eye(d)
    a = v / np.longdouble(scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    last = np.inf
    for step in range(rounds):
        high = step >= 2  # float64 takes the error from single to about double precision
        kind = np.longdouble if high else np.float64
        a_, x = a.astype(kind), x.astype(kind)
        r, s = np.eye(d, dtype=kind) - x.T @ x, x.T @ (a_ @ x)
        s = (s + s.T) / 2
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(value)
        # What rounding leaves in s must stay small against a gap that it is divided by; nearer ones are a cluster.
        near = max(2 * (norm(off) + norm(r)), float(np.finfo(kind).eps) ** 0.5)
        gap = value[None, :] - value[:, None]
        told = np.abs(gap) > near
        e = np.where(told, (s + value[None, :] * r) / np.where(told, gap, 1), r / 2)
        x = x + x @ e
        x = _clusters_solved(a_, x, value, near, kind)
        moved = norm(e)
        if high and (moved < d * 1e-18 or moved > last / 2 and moved < 1e-15):
            break
        last = moved
    x = x.astype(np.longdouble)
    x = x + x @ (np.eye(d, dtype=np.longdouble) - x.T @ x) / 2
    value = (x * (a @ x)).sum(axis=0) * np.longdouble(scale)
    order = np.argsort(-value, kind="stable")
    return value[order].astype(np.float64), x[:, order].astype(np.float64)


def _clusters_solved(a, x, value, near, kind):
    """Rotates the vectors of every run of eigenvalues that lie within ``near`` of the next one."""
    order = np.argsort(value)
    cuts = np.flatnonzero(np.diff(value[order]) > near) + 1
    for cluster in np.split(order, cuts):
        if len(cluster) > 1:
            part = x[:, cluster]
            middle = value[cluster].mean()
            inner = part.T @ (a @ part) - middle * (part.T @ part)  # small numbers: float64 tells them apart
            size = np.abs(inner).max()
            if size > 0:
                inner = ((inner + inner.T) / (2 * size)).astype(np.float64)
                w = np.linalg.eigh(inner)[1].astype(kind)
                w = w + w @ (np.eye(len(cluster), dtype=kind) - w.T @ w) / 2
                x[:, cluster] = part @ w
    return x


class Whitening:
    """What the fit list gives: n, the exact sums S, and components with their eigenvalues."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray, centre: list[int], most: int):
        d = len(sums)
        s = np.array([t - n * c for t, c in zip(sums, centre)], object)
        exact = n * products - s[:, None] * s[None, :]
        v = extended(exact) / np.longdouble(n) / np.longdouble(n)
        value, vectors = refined(v)
        trace = float(np.trace(v))
        kept = [j for j in range(min(d, most)) if value[j] > max(d, 1) * np.finfo(np.float64).eps * max(float(value[0]), 0.0)]
        self.n, self.rest, self.centre, self.d = n, s, np.array(centre, np.int64), d
        self.values, self.vectors, self.explained = value[kept], vectors[:, kept], value[kept] / trace if trace else value[kept]

    def apply(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(deviations, whitened) of integer vectors."""
        z = x - self.centre
        largest = int(np.abs(z).max(initial=0)) * self.n + max((abs(int(r)) for r in self.rest), default=0)
        if largest * largest * self.d < 1 << 63:
            y = z * self.n - self.rest.astype(np.int64)
            deviation = (y * y).sum(axis=1).tolist()
        else:
            y = z.astype(object) * self.n - self.rest
            deviation = [int(t) for t in (y * y).sum(axis=1)]
        return deviation, (y.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, d: int, n: int, components: int = COMPONENTS) -> Whitening:
    """Learns from all rows (v: complete vectors of dimension d)."""
    sums = column_sums(rows, d)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    return Whitening(n, sums, centred_products(rows, d, centre), centre, components)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity.

    Whitened rows have the mean zero by construction; what rounding leaves of it is measured too and taken out.
    """
    k = len(model.values)

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.apply(integers(batch, model.d))[1]
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    moments = np.array(summed(rows.mapInArrow(run, "i int, row array<double>"), k + 1, "double"))
    mean = moments[k] / model.n
    return float(np.abs(moments[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(table: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation decimal, whitened, explained, identity_error): one row per complete vector and component."""
    kind = table.schema[key].dataType.simpleString()
    rows, d, n = sized(table.select(F.col(key).alias("k"), F.col(vector).alias("v")), "v")
    model = fit(rows.select("v"), d, n, components) if n else None
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    error = identity_error(rows.select("v"), model)

    def run(batches):
        for batch in batches:
            deviation, w = model.apply(integers(batch, d))
            sums = pa.array(deviation, pa.int64()).cast(pa.decimal128(38, 0)) if max(deviation, default=0) < 1 << 62 else pa.array([Decimal(t) for t in deviation], pa.decimal128(38, 0))
            ends = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("k"), sums, pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))], ["k", "deviation", "w"])

    found = rows.mapInArrow(run, f"k {kind}, deviation decimal(38,0), w array<double>")
    explained = F.element_at(F.array(*(F.lit(float(e)) for e in model.explained)), F.col("component"))
    return found.select(F.col("k").alias(key), F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1).select(
        key, "component", "n", "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's deviation is a long; beyond it (some 47 million unit vectors) the cast raises an error, ``whitened`` goes on."""
    return whitened(session(spark).read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))
