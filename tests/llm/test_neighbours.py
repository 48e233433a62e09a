"""Learned partitions against brute force: exact scores, recall, copies and odd rows."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from fleetlake.llm import catalog, neighbours
from fleetlake.llm.neighbours import Block, Router, balanced, nearest

KIND = "vec_id long, embedding array<float>"


def brute(rows, asks, top=20):
    """{query: [(score, key)]} over different (key, vector) rows, best first."""
    good = sorted({(k, tuple(float(c) for c in v)) for k, v in rows})
    x = np.array([v for _, v in good])
    out = {}
    for q, v in ((k, v) for k, v in good if asks(k)):
        if q in out:
            continue
        s = np.zeros(len(x))
        for j, c in enumerate(v):
            s += c * x[:, j]
        out[q] = sorted((-a, k) for a, (k, _) in zip(s, good) if k != q)[:top]
    return out


def answers(df):
    out = {}
    for r in df.sort("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.1")])
def test_query_recall(spark, sf):
    found = catalog.QUERIES["op13_neighbours"](spark, sf)
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and dict(found.dtypes)["query_id"] == "bigint"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = answers(found), brute(rows, lambda k: k % 20 == 0)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    every = brute(rows, lambda k: k % 20 == 0, len(rows))
    assert all(set(g) <= set(every[q]) and g == sorted(g) for q, g in got.items())  # exact scores, ties by key
    assert recall(got, want) >= 0.9


def test_every_part_searched_is_brute_force(spark, monkeypatch):
    """With the whole mass the answer is exact, however small blocks and batches are."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=6).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # copies
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", 6 * 40)
    monkeypatch.setattr(neighbours, "QUERY_VALUES", 6 * 10)
    monkeypatch.setattr(neighbours, "TARGET", 1.0)
    monkeypatch.setattr(Router, "calibrate", lambda self, *a: None)
    df = spark.createDataFrame(rows, KIND).repartition(6)
    assert answers(neighbours.neighbours(df, F.col("k") % 7 == 0)) == brute(rows, lambda k: k % 7 == 0)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=4).astype(np.float32)]) for i in range(30)]
    rows += [rows[3], rows[3], (5, rows[6][1]), (0, rows[9][1])]  # repeated rows, keys with two vectors
    bad = [(60, None), (80, []), (100, [0.0] * 4), (120, [1.0, None, 0.0, 0.0]), (140, [float("nan"), 1.0, 1.0, 1.0]), (160, [float("-inf"), 1.0, 1.0, 1.0]), (180, [1.0, 2.0]), (None, [1.0] * 4), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2, "k", 0.5, "q") for r in [*rows, *bad]], KIND + ", part int, spread int, k string, score double, query string")
    got = answers(neighbours.neighbours(df, F.col("k") % 20 == 0))
    assert got == brute(rows, lambda k: k % 20 == 0) and set(got) == {0, 20}
    few = answers(neighbours.neighbours(df.where("vec_id in (20, 21, 22)"), F.col("k") % 20 == 0))
    assert [len(g) for g in few.values()] == [2]  # all candidates, if fewer
    for none in (df.limit(0), df.where("vec_id = 60"), df.where("vec_id = 20")):
        found = neighbours.neighbours(none, F.col("k") % 20 == 0)
        assert found.collect() == [] and found.columns == ["query_id", "rank", "vec_id", "score"]


def test_block_with_copies_keeps_smallest_keys():
    v = np.array([[1.0, 0.0]] * 50 + [[0.5, 0.5]] * 50)
    block = Block(np.arange(100)[::-1].copy(), v, 3)
    (own, found, scores), = block.best(np.array([51]), np.array([[1.0, 0.0]]))
    assert own == 51 and found.tolist() == [50, 52, 53] and scores.tolist() == [1.0] * 3 and len(block.keys) == 8


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16)) * 4
    rows = np.concatenate([c + rng.normal(size=(100, 16)) for c in centres])
    graph = nearest(rows, rows, 10, own=True)
    part = balanced(rows, graph, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 3
    cut = (part[np.repeat(np.arange(800), 10)] != part[graph.reshape(-1)]).mean()
    assert cut < 0.05  # the parts are the clusters; parts dealt by chance cut 7 of 8 edges


def test_router_learns_and_is_selective():
    """On clustered vectors a few parts hold nearly all neighbours; the calibrated recall holds for other queries."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 3
    rows = np.concatenate([c + rng.normal(size=(120, 16)) for c in centres])[rng.permutation(4800)]
    router = neighbours.learn(rows[:4000], 40_000)
    base, queries = rows[:4000], rows[4000:]
    true = router.home(base)[nearest(queries, base, 20)]
    owner, part = router.routes(queries)
    searched = np.zeros((len(queries), router.bias.size), bool)
    searched[owner, part] = True
    found = np.take_along_axis(searched, true, 1).mean()
    assert found >= 0.93 and searched.mean() < 0.1 and router.bias.size == neighbours.parts_for(40_000)
