"""Near-duplicate detection with HyperMinHash registers, banding and exact confirmation.

Registers. Each of BANDS * ROWS buckets hashes all shingles of a text by its own permutation and keeps of the smallest value the number of
leading zeros and the next MANTISSA bits (16 bits in all). Every bucket sees all shingles, so short texts fill them too.

Candidates. ROWS neighbouring registers make one band key; texts that share a key meet. At similarity 0.8 a pair misses all 42 bands
with a probability of 6e-8. Texts with equal shingle sets count once (``classes``).
 1. Every text of a bucket is paired with the bucket's first one. The registers estimate the similarity, corrected for chance collisions;
    pairs more than six standard errors below the threshold go, the others are confirmed on the full sets, and the links
    give first components.
 2. In buckets that still hold more than one component, the registers of texts of different components are compared where they
    lie; texts whose estimate reaches the bound are tied to one neighbourhood (one row per text, not per pair). A neighbourhood's full
    sets are intersected by an index of its shingles, in blocks of BLOCK texts, and what was found joins the components.
So no link between different texts is left out for the size of a bucket, and no row per pair of a bucket is made.

Hot groups: counting and smallest keys are aggregated before the shuffle, a first text with many partners is copied to slots of them, and
buckets and neighbourhoods are cut into blocks that meet in pairs. Components are found by rounds of joins that are checkpointed; nothing is collected.

Defined results: null and empty texts have no shingles, are their own component and linked with nothing. Texts with fewer words than a
shingle have one shingle, their whole sequence. A key that occurs more than once is linked by any of its texts. Rows without a key are
not compared; they stay and have no component. Ties go to the smallest key. Only named columns are returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm.common import Hasher, checkpointed, distinct, documents, mixed, slices, window_hashes

ROWS, BANDS, MANTISSA = 5, 42, 10
REGISTERS = ROWS * BANDS
SLOT = 256  # partners of one text that are confirmed together
BUCKET = 1000  # texts of a bucket whose registers are compared together
BLOCK = 2000  # texts of a neighbourhood that are indexed together
FEW_KEYS = 1_000_000  # up to 8 MB of keys are sent to every task, more are joined by a shuffle
# Fixed value: chance that two different smallest values share a register, in units of 2**-MANTISSA, for sets of one size.
CHANCE = 0.1699


def shingles(texts: list[bytes | None], size: int, hasher: Hasher) -> list[np.ndarray]:
    """The different hashes of all runs of ``size`` words of each text, sorted."""
    hashes, counts = hasher.of_texts(texts)
    ends = np.cumsum(counts)
    return [distinct(window_hashes(hashes[e - n : e], min(size, n))) if n else hashes[:0] for e, n in zip(ends.tolist(), counts.tolist())]


def permutations() -> np.ndarray:
    return mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Leading zeros and mantissa of the smallest value of every bucket, for sets that are not empty."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for j, factor in enumerate(permutations()):
        least[:, j] = np.minimum.reduceat(flat * factor, starts)
    top = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # bits in use; rounding up at a power of two changes both sides alike
    shift = top - 1 - MANTISSA
    mantissa = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(np.uint64), least) & np.uint64((1 << MANTISSA) - 1)
    return ((64 - np.minimum(top, 64)).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def band_keys(found: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(found), BANDS)).copy()
    for j in range(ROWS):
        keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + found[:, j::ROWS].astype(np.uint64))
    return keys.view(np.int64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, without those that are equal by chance."""
    chance = CHANCE * 2.0**-MANTISSA
    return (equal - chance) / (1 - chance)


def bound(threshold: int) -> float:
    t = threshold / 100
    return t - 6 * (t * (1 - t) / REGISTERS) ** 0.5


def sketches(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(k, n, same, registers): set size, a hash of the whole set, packed registers (null for empty sets)."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        hasher = Hasher(lower=True)
        for batch in batches:
            for part in slices(batch):
                sets = shingles(part.column("text").to_pylist(), size, hasher)
                filled = [s for s in sets if len(s)]
                packed = iter(registers(filled)) if filled else iter(())
                regs = [next(packed).tobytes() if len(s) else None for s in sets]
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(regs, pa.binary())], ["k", "n", "same", "registers"])

    return rows.mapInArrow(run, "k long, n long, same binary, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """(key, k): one row per band."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "registers"):
                found = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                k = np.repeat(part.column("k").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(found).reshape(-1)), pa.array(k)], ["key", "k"])

    return classes.select("k", "registers").mapInArrow(run, "key long, k long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(k, component) of all keys in links: smallest key reachable, by joining every key's smallest neighbour and its neighbour's."""
    both = links.select(F.col(a).alias("k"), F.col(b).alias("o")).where("k <> o")
    edges = checkpointed(both.unionAll(both.select(F.col("o").alias("k"), F.col("k").alias("o"))).distinct())
    labels = checkpointed(edges.groupBy("k").agg(F.least(F.min("o"), F.col("k")).alias("component")))
    while True:
        # What the neighbours know, then what the label itself knows (pointer jumping).
        heard = edges.join(labels.withColumnRenamed("k", "o"), "o").select("k", "component").unionAll(labels)
        near = heard.groupBy("k").agg(F.min("component").alias("component"))
        jump = near.select(F.col("k").alias("component"), F.col("component").alias("further"))
        new = checkpointed(near.join(jump, "component", "left").select("k", F.least("further", "component").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "was"), "k").where("component <> was").limit(1).count()
        labels = new
        if not changed:
            return labels


def texts_of(docs: DataFrame, keys: DataFrame, key: str, text: str) -> DataFrame:
    """(k, text) of the given distinct keys; few keys are sent to the scan, many meet it by a shuffle."""
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("text")).where("k is not null")
    return rows.join(F.broadcast(keys) if few else keys, "k", "left_semi")


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if 100 * small < threshold * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (small + large - both)


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, threshold: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    whole = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), key, text)
    slots = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))
    firsts = slots.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).join(whole.withColumnRenamed("k", "a"), "a").select("a", "slot", "text").toDF("a", "slot", "text")
    others = pairs.join(slots, "a").withColumn("slot", F.pmod(F.xxhash64("b"), "slots").cast("int")).join(whole.withColumnRenamed("k", "b"), "b").select("a", "slot", "b", "text").toDF("a", "slot", "b", "text")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            own, *sets = shingles([left.column("text")[0].as_py(), *right.column("text").to_pylist()], size, Hasher(lower=True))
            found = [b for b, s in zip(right.column("b").to_pylist(), sets) if similar(own, s, threshold)]
        a = left.column("a")[0].as_py() if found else None
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return firsts.groupBy("a", "slot").cogroup(others.groupBy("a", "slot")).applyInArrow(check, "a long, b long")


def _tied(table: pa.Table, least: float) -> pa.Table:
    """Texts of one bucket (or of two of its blocks) with a likely partner in another component, each with the first text of its neighbourhood."""
    order = np.lexsort((table.column("k").to_numpy(), table.column("component").to_numpy()))
    k, component, side = (table.column(c).to_numpy()[order] for c in ("k", "component", "side"))
    packed = table.column("registers").to_pylist()
    found = np.frombuffer(b"".join(packed[i] for i in order), np.uint16).reshape(-1, REGISTERS)
    root = np.arange(len(k))
    two = side.max() > side.min()
    names, sizes = np.unique(component, return_counts=True)
    main = names[sizes.argmax()]
    # Of two blocks one side's texts meet the other's; in one block every pair of components has a text outside the largest one.
    for i in np.flatnonzero(side == side.min()) if two else np.flatnonzero(component != main):
        others = np.flatnonzero((component != component[i]) & (side != side[i] if two else True))
        near = others[estimate((found[others] == found[i]).mean(axis=1)) >= least]
        if len(near):
            near = np.append(near, i)
            root[np.isin(root, root[near])] = root[near].min()
    tied = np.isin(root, np.flatnonzero(np.bincount(root, minlength=len(k)) > 1))
    return pa.table({"a": pa.array(k[root[tied]], pa.int64()), "b": pa.array(k[tied], pa.int64())})


def in_blocks(rows: DataFrame, group: str, size: int, *columns: str) -> DataFrame:
    """Rows of a group dealt to blocks of about ``size``, each pair of blocks (low, high) a group of its own; ``side`` tells the two apart."""
    blocks = rows.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(blocks, group).withColumn("side", F.pmod(F.xxhash64("k"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(group, *columns, "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))


def _between(table: pa.Table, size: int, threshold: int) -> pa.Table:
    """Links between texts of different components in one block (or between two), by an index of their shingles."""
    k, component, side = (table.column(c).to_numpy() for c in ("k", "component", "side"))
    sets = shingles(table.column("text").to_pylist(), size, Hasher(lower=True))
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, ordered = np.repeat(np.arange(len(sets)), sizes)[order], flat[order]
    two = side.max() > side.min()
    names, counts = np.unique(component, return_counts=True)
    main, root, a, b = names[counts.argmax()], {}, [], []

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    for i in np.flatnonzero((side == side.min()) if two else (component != main)):
        low, high = np.searchsorted(ordered, sets[i]), np.searchsorted(ordered, sets[i], side="right")
        shared = np.bincount(np.concatenate([owner[x:y] for x, y in zip(low, high)]), minlength=len(sets))
        linked = (100 * shared >= threshold * (sizes + sizes[i] - shared)) & (component != component[i])
        if two:
            linked &= side != side[i]
        for j in np.flatnonzero(linked):  # one link for each pair of components that is not joined yet
            x, y = find(component[i]), find(component[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(k[i])
                b.append(k[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of all documents; ``kept`` marks the smallest key of each component."""
    found = checkpointed(sketches(docs, size, key, text))
    classes = checkpointed(found.where("n > 0 and k is not null").groupBy("same").agg(F.min("k").alias("k"), F.first("registers").alias("registers")).select("same", "k", "registers"))
    keyed = bands(classes)
    firsts = keyed.groupBy("key").agg(F.min("k").alias("a"), F.count("*").alias("texts")).where("texts > 1").select("key", "a")
    shared = checkpointed(keyed.join(firsts, "key").select("key", "k", "a"))
    pairs = shared.where("k <> a").select("a", F.col("k").alias("b")).distinct()
    sketch = classes.select("k", "registers")
    least = bound(threshold)

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array(estimate((x == y).mean(axis=1)) >= least))

    with_both = pairs.join(sketch.select(F.col("k").alias("a"), F.col("registers").alias("x")), "a").join(sketch.select(F.col("k").alias("b"), F.col("registers").alias("y")), "b")
    candidates = checkpointed(with_both.select("a", "b", "x", "y").mapInArrow(likely, "a long, b long"))
    links = checkpointed(confirmed(candidates, docs, size, threshold, key, text))
    joined = components(links)

    # Buckets that still hold several components.
    members = shared.join(joined, "k", "left").select("key", "k", F.coalesce("component", "k").alias("component"))
    open_keys = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_rows = in_blocks(members.join(open_keys, "key"), "key", BUCKET, "k", "component").join(sketch, "k")
    ties = checkpointed(open_rows.groupBy("key", "low", "high").applyInArrow(lambda t: _tied(t, least), "a long, b long"))
    hoods = components(ties).withColumnRenamed("component", "hood")
    placed = hoods.join(joined, "k", "left").select("k", "hood", F.coalesce("component", "k").alias("component"))
    met = in_blocks(placed, "hood", BLOCK, "k", "component")
    whole = texts_of(docs, hoods.select("k"), key, text)
    further = met.join(whole, "k").groupBy("hood", "low", "high").applyInArrow(lambda t: _between(t, size, threshold), "a long, b long")
    last = components(links.unionAll(checkpointed(further)))

    first_of = classes.select("same", F.col("k").alias("class"))
    ends = last.select(F.col("k").alias("class"), "component")
    named = first_of.join(ends, "class", "left").select("same", F.coalesce("component", "class").alias("component"))
    own = F.when(F.col("k").isNotNull(), F.coalesce("component", "k"))
    done = found.select("k", "n", "same").join(named, "same", "left").select("k", "n", own.alias("component"))
    return done.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("k") == F.col("component"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows, with all their columns, without those that are not their component's first key."""
    dropped = near_duplicates(docs, size, threshold, key, text).where("not kept").select(F.col(key).alias("dropped key")).distinct()
    return docs.join(dropped, docs[key].cast("long") == F.col("dropped key"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=2)
