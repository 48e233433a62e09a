"""Approximate nearest neighbours by learned partitions.

Learning takes a bounded sample (FIT_ROWS vectors, whatever the table's size) and three steps on the driver:
 1. the sample's neighbour graph (each vector's NEAREST nearest), halved again and again into parts of equal size with few edges
    between them: by the second eigenvector of the graph, then by swaps that cut fewer edges;
 2. a softmax classifier that learns from a vector in which parts its neighbours lie;
 3. the mass of probability that a query's parts must reach: the smallest with a recall of TARGET on CALIBRATION sample vectors that the
    classifier has not seen.

The index holds every vector in its most probable part, large parts in blocks of BLOCK_VALUES numbers, written once (a checkpoint). A query goes
to its most probable parts up to that mass, to all blocks of each. Blocks meet batches of queries in one task each; a task scores with matrix
products and gives each query's best rows, which are ranked with exact scores. A larger table makes more blocks, not larger tasks.

Copies. Inside a block, equal vectors are one row with their smallest keys, as many as a list has places. So a third of all rows
being copies makes more blocks, but no more work per block. Nothing is capped: blocks are searched whole.

Nearness is the inner product in double precision, summed in the order of the dimensions; equal scores rank by ascending key.

Defined results: vectors that are null, zero, empty or hold null or non-finite entries take no part, and neither do those of another than the commonest
dimension, nor rows without a key. Rows equal in key and vector are one row. A key with several vectors can be found once with each; as a query
it asks with the smallest of them, and none of its own rows is found. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import checkpointed, session, uniform
from fleetlake.llm.vectors import sized

TOP = 20
FIT_ROWS = 8192
CALIBRATION = 1024  # of them
NEAREST = 10
MOST_PARTS = 64
TARGET = 0.96
BLOCK_VALUES = 2 << 20
QUERY_VALUES = 1 << 20


def nearest(queries: np.ndarray, rows: np.ndarray, count: int, own: bool = False) -> np.ndarray:
    """Places of each query's nearest rows, unordered. ``own``: queries are the rows, and not their own neighbours."""
    out = []
    for at in range(0, len(queries), 512):
        scores = queries[at : at + 512] @ rows.T
        if own:
            scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out.append(np.argpartition(-scores, count - 1, axis=1)[:, :count])
    return np.concatenate(out)


def halves(start: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cuts a graph (edges left-right) into equal halves; ``start`` orders its nodes roughly."""
    n = len(start)
    both = np.concatenate([left, right]), np.concatenate([right, left])
    degree = np.bincount(both[0], minlength=n) + 1.0
    root = np.sqrt(degree)
    x = start - (start @ root) / (root @ root) * root
    for _ in range(40):  # towards the second eigenvector of the graph
        x = x + (np.bincount(both[0], (x / root)[both[1]], n) + x / root) / root
        x -= (x @ root) / (root @ root) * root
        x /= max(float(np.linalg.norm(x)), 1e-300)
    side = np.zeros(n, np.int64)
    side[np.argsort(x / root, kind="stable")[n // 2 :]] = 1
    cut = (side[left] != side[right]).sum()
    for _ in range(30):
        other = np.bincount(both[0], side[both[0]] != side[both[1]], n)
        gain = 2 * other - (degree - 1)
        a, b = (np.flatnonzero(side == s) for s in (0, 1))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        pairs = min(len(a), len(b))
        good = int((gain[a[:pairs]] + gain[b[:pairs]] > 0).sum())
        while good:  # neighbours that swap together may gain less than each alone
            tried = side.copy()
            tried[a[:good]], tried[b[:good]] = 1, 0
            if (now := (tried[left] != tried[right]).sum()) < cut:
                side, cut = tried, now
                break
            good //= 2
        if not good:
            break
    return side


def balanced(rows: np.ndarray, neighbours: np.ndarray, parts: int) -> np.ndarray:
    """The part of every row: ``parts`` (a power of two) parts of the neighbour graph, equal in size to one row a cut."""
    left, right = np.repeat(np.arange(len(rows)), neighbours.shape[1]), neighbours.reshape(-1)
    part, count = np.zeros(len(rows), np.int64), 1
    while count < parts:
        new = part * 2
        for p in range(count):
            here = np.flatnonzero(part == p)
            if len(here) < 2:
                continue
            place = np.full(len(rows), -1)
            place[here] = np.arange(len(here))
            inner = (place[left] >= 0) & (place[right] >= 0)
            centred = rows[here] - rows[here].mean(axis=0)
            axis = centred[np.argmax((centred * centred).sum(axis=1))]
            for _ in range(8):
                axis = centred.T @ (centred @ axis)
                axis /= max(float(np.linalg.norm(axis)), 1e-300)
            new[here] += halves(centred @ axis, place[left[inner]], place[right[inner]])
        part, count = new, count * 2
    return part


class Router:
    """A softmax classifier of vectors, with the probability mass to search."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, mean: np.ndarray, spread: float):
        self.weights, self.bias, self.mean, self.spread, self.mass, self.recall = weights, bias, mean, spread, 1.0, 1.0

    @classmethod
    def learn(cls, rows: np.ndarray, shares: np.ndarray, rounds: int = 40, batch: int = 256) -> Router:
        """Cross-entropy to the shares by Adam, over shuffled batches in a fixed order."""
        mean = rows.mean(axis=0)
        spread = float(np.sqrt(((rows - mean) ** 2).mean())) or 1.0
        x, rng = ((rows - mean) / spread).astype(np.float32), np.random.default_rng(7)
        w = np.zeros((rows.shape[1] + 1, shares.shape[1]), np.float32)
        x, y = np.column_stack([x, np.ones(len(x), np.float32)]), shares.astype(np.float32)
        first, second, step = np.zeros_like(w), np.zeros_like(w), 0
        for round_ in range(rounds):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                step += 1
                here = order[at : at + batch]
                grad = x[here].T @ (softmax(x[here] @ w) - y[here]) / len(here) + 1e-5 * w
                first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
                rate = 0.05 * (1 - round_ / rounds)
                w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return cls(w[:-1].astype(np.float64), w[-1].astype(np.float64), mean, spread)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return softmax((rows - self.mean) / self.spread @ self.weights + self.bias)

    def home(self, rows: np.ndarray) -> np.ndarray:
        return self.probabilities(rows).argmax(axis=1)

    def routes(self, rows: np.ndarray, mass: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) pairs: each row's most probable parts until they hold the mass."""
        p = self.probabilities(rows)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
        owner, at = np.nonzero(before < (self.mass if mass is None else mass))
        return owner, order[owner, at]

    def calibrate(self, queries: np.ndarray, rows: np.ndarray, top: int, target: float) -> None:
        """Sets the mass: the smallest with the target recall for these queries among these rows."""
        found = self.home(rows)[nearest(queries, rows, min(top, len(rows)))]
        p = self.probabilities(queries)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, 1)
        before = np.empty_like(p)
        np.put_along_axis(before, order, np.cumsum(ranked, axis=1) - ranked, 1)
        needed = np.sort(np.take_along_axis(before, found, 1).reshape(-1))  # a neighbour is found by a mass beyond this
        at = min(len(needed) - 1, math.ceil(target * len(needed)) - 1)
        self.mass, self.recall = float(np.nextafter(needed[at], 2)), (at + 1) / len(needed)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def parts_for(rows: int, most: int = MOST_PARTS) -> int:
    """A power of two near a quarter of the root of the table's rows."""
    return min(most, 1 << max(0, round(math.log2(max(1.0, math.sqrt(rows) / 4)))))


def learn(sample: np.ndarray, rows: int, top: int = TOP, target: float = TARGET) -> Router:
    """A router for a table of ``rows`` vectors like these (different ones, at most FIT_ROWS)."""
    d = sample.shape[1]
    held = min(CALIBRATION, len(sample) // 4)
    queries, base = sample[:held], sample[held:]
    parts = min(parts_for(rows), 1 << max(0, int(math.log2(max(1, len(base) // (2 * NEAREST))))))
    if parts < 2:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros(d), 1.0)
    graph = nearest(base, base, NEAREST, own=True)
    part = balanced(base, graph, parts)
    shares = np.zeros((len(base), parts))
    np.add.at(shares, (np.repeat(np.arange(len(base)), NEAREST), part[graph.reshape(-1)]), 0.5 / NEAREST)
    shares[np.arange(len(base)), part] += 0.5
    router = Router.learn(base, shares)
    router.calibrate(queries, base, top, target)
    return router


def usable(table: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """Rows (k, v as doubles) that take part, their dimension and about how many there are."""
    rows = table.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null")
    return sized(rows.where(F.exists("v", lambda c: c != 0)), "v")


def fit(rows: DataFrame, count: int, d: int, top: int = TOP, target: float = TARGET) -> Router:
    """Learns from FIT_ROWS rows at most, chosen by a hash of key and vector; copies among them count once."""
    share = min(1.0, 1.2 * FIT_ROWS / max(1, count))
    drawn = rows.select(F.xxhash64("k", "v").alias("h"), "v", uniform("k", "v").alias("u")).where(F.col("u") <= share)
    picked = [r["v"] for r in drawn.sort("u", "h").limit(FIT_ROWS).select("v").collect()]
    return learn(_different(np.array(picked, np.float64).reshape(-1, d)), count, top, target)


def _different(sample: np.ndarray) -> np.ndarray:
    """Different vectors, in the order of their first row."""
    return sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def indexed(rows: DataFrame, router: Router, d: int) -> DataFrame:
    """(part, spread, k, v) of every row, checkpointed; ``spread`` deals the rows of a part to blocks, repeated rows too."""
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            home = router.home(matrix(batch.column("v"), d)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), batch.column("k"), batch.column("v")], ["part", "k", "v"])

    placed = rows.mapInArrow(run, f"part int, k {kind}, v array<double>")
    return checkpointed(placed.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())))


def _routed(queries: DataFrame, router: Router, d: int) -> DataFrame:
    kind = queries.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                owner, part = router.routes(matrix(batch.column("v"), d))
                owner = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column("k").take(owner), batch.column("v").take(owner)], ["part", "k", "v"])

    return queries.mapInArrow(run, f"part int, k {kind}, v array<double>")


def _shares(rows: DataFrame, each: int) -> list[int]:
    """For every part how many shares of about ``each`` rows it has; parts are at most MOST_PARTS."""
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    return [max(1, math.ceil(counts.get(p, 0) / each)) for p in range(max(counts, default=0) + 1)]


def _of_part(shares: list[int]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, shares)), F.col("part")), F.lit(1))


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of one query, summed dimension by dimension, so that equal vectors have equal scores."""
    out = np.zeros(len(rows))
    for j in range(len(query)):
        out += query[j] * rows[:, j]
    return out


class Block:
    """Index rows that one task searches: different vectors with their smallest keys."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, top: int):
        order = np.argsort(keys, kind="stable")
        keys, vectors = keys[order], vectors[order]
        self.vectors, which = np.unique(vectors, axis=0, return_inverse=True)
        order = np.argsort(which.reshape(-1), kind="stable")
        which, keys = which.reshape(-1)[order], keys[order]
        new = np.append(True, (which[1:] != which[:-1]) | (keys[1:] != keys[:-1]))  # rows equal in key and vector are one
        which, keys = which[new], keys[new]
        starts = np.searchsorted(which, np.arange(len(self.vectors)))
        few = np.arange(len(which)) - starts[which] <= top  # one more than places, as the query's own row may be among them
        self.wanted = top + int(np.unique(keys, return_counts=True)[1].max(initial=0))  # different vectors that hold enough rows of other keys
        self.keys = keys[few]
        self.starts = np.searchsorted(which[few], np.arange(len(self.vectors) + 1))
        self.scale = np.abs(self.vectors).sum(axis=1).max(initial=0)
        self.top = top

    def best(self, keys: np.ndarray, queries: np.ndarray):
        """(query key, key, score) lists of each query's best rows here."""
        for at in range(0, len(queries), 128):
            part = queries[at : at + 128]
            scores = part @ self.vectors.T
            count = min(self.wanted, scores.shape[1])
            last = -np.partition(-scores, count - 1, axis=1)[:, count - 1]
            slack = 1e-13 * len(part[0]) * np.abs(part).max(axis=1) * self.scale  # far beyond what the order of sums changes
            for i in range(len(part)):
                near = np.flatnonzero(scores[i] >= last[i] - slack[i])
                exact = exact_scores(part[i], self.vectors[near])
                sizes = self.starts[near + 1] - self.starts[near]
                found = np.concatenate([self.keys[self.starts[v] : self.starts[v + 1]] for v in near])
                exact = np.repeat(exact, sizes)
                other = found != keys[at + i]
                found, exact = found[other], exact[other]
                order = np.argsort(found, kind="stable")
                order = order[np.argsort(-exact[order], kind="stable")][: self.top]
                yield keys[at + i], found[order], exact[order]


def search(index: DataFrame, queries: DataFrame, router: Router, d: int, top: int = TOP) -> DataFrame:
    """(query, rank, k, score): the best rows of an index for queries (k, v)."""
    kind = index.schema["k"].dataType.simpleString()
    asked = _routed(queries, router, d)
    blocks, batches_ = _shares(index, max(1, BLOCK_VALUES // d)), _shares(asked, max(1, QUERY_VALUES // d))
    own_block, own_batch = F.pmod(F.col("spread"), _of_part(blocks)).cast("int"), F.pmod(F.xxhash64("k"), _of_part(batches_)).cast("int")
    rows = index.select("part", own_block.alias("block"), F.explode(F.sequence(F.lit(0), _of_part(batches_) - 1)).alias("batch"), "k", "v")
    asking = asked.select("part", F.explode(F.sequence(F.lit(0), _of_part(blocks) - 1)).alias("block"), own_batch.alias("batch"), "k", "v")
    ktype = index.select("k").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("query", ktype), ("k", ktype), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        block = Block(left.column("k").to_numpy(), matrix(left.column("v").combine_chunks(), d), top)
        found = list(block.best(right.column("k").to_numpy(), matrix(right.column("v").combine_chunks(), d)))
        owner = np.repeat(np.arange(len(found)), [len(f[1]) for f in found])
        if not len(owner):
            return schema.empty_table()
        columns = [pa.array([found[i][0] for i in owner.tolist()], ktype), pa.array(np.concatenate([f[1] for f in found]), ktype), pa.array(np.concatenate([f[2] for f in found]))]
        return pa.Table.from_arrays(columns, schema=schema)

    group = ("part", "block", "batch")
    near = rows.groupBy(*group).cogroup(asking.groupBy(*group)).applyInArrow(run, f"query {kind}, k {kind}, score double")
    near = near.repartition("query").distinct()  # one shuffle for both; repeated rows may lie in several blocks
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("k")))
    return near.withColumn("rank", place).where(F.col("rank") <= top).select("query", "rank", "k", "score")


def neighbours(table: DataFrame, asks: Column, top: int = TOP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): for the rows that ``asks`` (a condition on the key, named k) picks, the nearest others found."""
    rows, d, count = usable(table, key, vector)
    if not count:
        kind = table.schema[key].dataType.simpleString()
        return table.sparkSession.createDataFrame([], f"query_id {kind}, rank int, `{key}` {kind}, score double")
    router = fit(rows, count, d, top)
    queries = rows.where(asks).groupBy("k").agg(F.min("v").alias("v"))
    found = search(indexed(rows, router, d), queries, router, d, top)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("k").alias(key), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = session(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(table, F.col("k") % 20 == 0)
