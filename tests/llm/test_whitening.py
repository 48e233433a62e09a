"""Whitening against exact integers and float64 decompositions."""

from fractions import Fraction

import numpy as np
import pytest
from conftest import SF

from fleetlake.llm import catalog, whitening
from fleetlake.llm.whitening import refined

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def held(vectors, rows, components=32):
    """Asserts that rows are the whitening of {key: vector}, by plain restatement."""
    keys = list(vectors)
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in vectors[k]] for k in keys], object)
    n, d = x.shape
    s = x.sum(axis=0)
    y = x * n - s
    deviation = {k: int((row * row).sum()) for k, row in zip(keys, y)}
    z = y.astype(np.float64) / n
    v = z.T @ z / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    by = {(r["vec_id"], r["component"]): r for r in rows}
    k = min(d, components)
    assert len(by) == len(rows) == n * k
    for c in range(1, k + 1):
        got = np.array([by[key, c]["whitened"] for key in keys])
        assert all(by[key, c]["n"] == n and by[key, c]["deviation"] == deviation[key] for key in keys)
        assert abs(by[keys[0], c]["explained"] - values[c - 1] / values.sum()) < 1e-10
        want = z @ axes[:, c - 1] / np.sqrt(values[c - 1])
        gap = min((abs(values[c - 1] - values[j]) for j in range(d) if j != c - 1), default=1)
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-10 * values[0] / gap + 1e-9
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_query_equals_restatement(spark):
    rows = catalog.QUERIES["op12_whitening"](spark, SF)
    assert rows.columns == COLUMNS and dict(rows.dtypes)["deviation"] == "bigint"
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    held({r["vec_id"]: r["embedding"] for r in table}, rows.collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = {i: [float(c) for c in rng.normal(size=5).astype(np.float32)] for i in range(40)}
    good[40] = [1e4, -1e4, 0.0, 2.0, 3.0]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (None, None)]
    rows = [(k, v, "a", 1, 2.0, "w") for k, v in [*good.items(), *bad]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, k string, i int, row double, v string")
    held(good, whitening.whitened(df).collect())
    doubled = whitening.whitened(df.unionAll(df)).collect()  # repeated rows count twice
    assert len(doubled) == 2 * 41 * 5 and {r["n"] for r in doubled} == {82} and doubled[0]["identity_error"] < 1e-9


def test_tables_without_a_spread(spark):
    kind = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        found = whitening.whitened(spark.createDataFrame(rows, kind))
        assert found.collect() == [] and found.columns == COLUMNS
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], kind)).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12  # one direction alone has a spread
    keyless = whitening.whitened(spark.createDataFrame([(None, [float(i), float(i * i % 7)]) for i in range(9)], kind)).collect()
    assert len(keyless) == 18 and keyless[0]["vec_id"] is None


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + 977 * i), float(-(2**39) + 13 * i * i), float(i)]) for i in range(30)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[64 * int(c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((30 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in found} == want
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(spark.createDataFrame([(1, [1e30]), (2, [2.0])], "vec_id long, embedding array<double>")).collect()


def matrix(values, seed=0):
    """A symmetric matrix of known eigenvalues, in extended precision."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ (np.eye(d, dtype=np.longdouble) - q.T @ q) / 2
    return q @ np.diag(np.array(values, np.longdouble)) @ q.T, q


@pytest.mark.parametrize("values", [
    list(np.linspace(90, 40, 48)),
    [150.0, *[60 + 1e-9 * i for i in range(20)], *np.linspace(50, 40, 20)],  # a cluster below single precision
    [9.0, 5.0, 5.0, 5.0, 5.0 + 1e-13, 2.0, 1.0],  # equal to double precision
    [1e6, 1.0, 1 - 1e-7, 1e-3, 1e-3 + 1e-10],
    [3.0] * 8,
])
def test_refined_eigenvectors(values):
    v, q = matrix(values)
    got, x = refined(v)
    x, want = x.astype(np.longdouble), np.sort(values)[::-1]
    assert np.abs(got - want).max() < 1e-14 * want[0]
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15
    residual = np.abs(v @ x - x * got.astype(np.longdouble)).max()
    assert residual < 2e-14 * want[0] / 10 + 1e-15
    order = np.argsort(-np.array(values), kind="stable")
    for j, at in enumerate(order):  # eigenvectors apart from others agree to double precision over their gap
        gap = min((abs(values[at] - o) for i, o in enumerate(values) if i != at), default=1)
        if gap > 1e-10 * want[0]:
            one = x[:, j] * np.sign((x[:, j] * q[:, at]).sum())
            assert np.abs(one - q[:, at]).max() < 1e-15 + 1e-18 * want[0] / gap


def test_mixed_precision_gains_over_single():
    v, _ = matrix(list(np.linspace(90, 40, 32)))
    single = np.linalg.eigh(v.astype(np.float32))[1].astype(np.longdouble)
    off = single.T @ v @ single
    got, x = refined(v)
    after = x.T.astype(np.longdouble) @ v @ x
    assert np.abs(after - np.diag(np.diag(after))).max() < 1e-7 * np.abs(off - np.diag(np.diag(off))).max()


def test_covariance_is_exact(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(200, 3)) * [1e-2, 1, 300]
    rows = spark.createDataFrame([(v.tolist(),) for v in values], "v array<double>").repartition(5)
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in values]
    sums = whitening.column_sums(rows, 3)
    assert sums == [sum(c) for c in zip(*x)]
    centre = [round(Fraction(s, 200)) for s in sums]
    want = [[sum((v[i] - centre[i]) * (v[j] - centre[j]) for v in x) for j in range(3)] for i in range(3)]
    assert whitening.centred_products(rows, 3, centre).tolist() == want
