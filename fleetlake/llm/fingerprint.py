"""Document fingerprints: a quartile digest of hashed byte triplets.

Every three neighbouring bytes of the UTF-8 text fall into one of 256 buckets. A bucket's digit says between which quartiles of all
256 counts its own count lies (0 to 3); the digest is one length byte, the quartile shape and 64 bytes of digits, in hex. The
difference of two digests is the sum of the digits' distances over the sum of the larger digits, raised by a bounded share for
different lengths, so it lies between 0 and 1 for texts of any length; ``likeness`` is 1 minus it.

Null text is empty text. Texts of fewer than three bytes have no triplets; their digests differ by length alone. Equal texts have
equal digests. Null keys sort first; rows with one key follow each other by text. Only the named columns are returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import checkpointed, documents, mixed, parts, slices, total_chars

BUCKETS = 256
FAR = 48  # steps of length (a factor of 64) beyond which only half of the likeness is left, however much longer one text is
HEX = 2 * (2 + BUCKETS // 4)


def _tables() -> np.ndarray:
    """Three tables that scatter a byte by its place in the triplet."""
    return mixed(np.arange(1, 3 * 256 + 1, dtype=np.uint64)).reshape(3, 256)


def digest_bytes(texts: list[bytes]) -> np.ndarray:
    """One row of digest bytes per text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    if len(flat) > 2:
        a, b, c = _tables()
        bucket = ((a[flat[:-2]] ^ b[flat[1:-1]] ^ c[flat[2:]]) >> np.uint64(17)).astype(np.int64) & (BUCKETS - 1)
        inside = owner[:-2] == owner[2:]
        counts = np.bincount((owner[:-2] * BUCKETS + bucket)[inside], minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
    ordered = np.sort(counts, axis=1)
    quartiles = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    digits = (counts[:, :, None] > quartiles[:, None, :]).sum(axis=2).astype(np.uint8)
    packed = digits.reshape(len(texts), BUCKETS // 4, 4)
    packed = packed[:, :, 0] << 6 | packed[:, :, 1] << 4 | packed[:, :, 2] << 2 | packed[:, :, 3]
    length = np.minimum(255, np.floor(np.log2(sizes + 1.0) * 8)).astype(np.uint8)  # a step is a ninth more bytes
    top = np.maximum(quartiles[:, 2], 1)
    shape = (quartiles[:, 0] * 15 // top << 4 | quartiles[:, 1] * 15 // top).astype(np.uint8)
    return np.concatenate([length[:, None], shape[:, None], packed], axis=1)


def difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bounded difference of digests, row by row: 0 for equal ones, 1 where no bucket's digits meet."""

    def digits(d: np.ndarray) -> np.ndarray:
        return np.concatenate([d[:, 2:] >> s & 3 for s in (6, 4, 2, 0)], axis=1).astype(np.int64)

    a, b = digits(x), digits(y)
    apart = np.abs(a - b).sum(axis=1) / np.maximum(np.maximum(a, b).sum(axis=1), 1)
    length = np.minimum(np.abs(x[:, 0].astype(np.int64) - y[:, 0]), FAR) / (2 * FAR)
    return 1 - (1 - apart) * (1 - length)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1.0 - difference(x, y)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = digest_bytes([x or b"" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([d.tobytes().hex() for d in found])], ["k", "fingerprint"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, fingerprint string").withColumnRenamed("k", key)


def compare(pairs: DataFrame, left: str = "left", right: str = "right", out: str = "likeness") -> DataFrame:
    """Adds the likeness of two fingerprint columns; null where one is null."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(left).to_pylist(), batch.column(right).to_pylist()
            known = [i for i, (x, y) in enumerate(zip(a, b)) if x and y]
            near: list[float | None] = [None] * len(a)
            if known:
                x, y = (np.frombuffer(bytes.fromhex("".join(side[i] for i in known)), np.uint8).reshape(len(known), -1) for side in (a, b))
                for i, v in zip(known, likeness(x, y).tolist()):
                    near[i] = v
            kept = [i for i, f in enumerate(batch.schema.names) if f != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(near, pa.float64())], [*(batch.schema.names[i] for i in kept), out])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name != out]
    return pairs.mapInArrow(run, ", ".join([*kept, f"{out} double"]))


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(keys: list, texts: list[str], following: list[str]) -> dict[str, list]:
    """The result columns for texts and the texts that follow them."""
    cuts = [len(t) // 4 for t in texts]
    edited = [(t[: len(t) - k] + n[:k]).encode() for t, n, k in zip(texts, following, cuts)]
    own, other, after = digest_bytes([t.encode() for t in texts]), digest_bytes(edited), digest_bytes([n.encode() for n in following])
    return {
        "k": keys, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
        "fingerprint": [d.tobytes().hex() for d in own], "edited_fingerprint": [d.tobytes().hex() for d in other],
        "near_edited": likeness(own, other).tolist(), "near_next": likeness(own, after).tolist(),
    }


def edited_by_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (the tail gives way to the head of the next row in key order) and their likeness.

    Rows are range-partitioned and sorted by key; each task walks its rows and leaves its first and last text as edges, which meet the
    neighbouring partition's by a join. The walk's output is checkpointed, so that both uses see one partitioning.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    count = parts(total_chars(rows, "text"))
    order = ["k", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(count, "k", F.xxhash64("text")).sortWithinPartitions(*order)
    schema = pa.schema([("part", pa.int32()), ("edge", pa.string()), ("k", dict_type(kind)), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def walk(batches):
        here, held = TaskContext.get().partitionId(), None

        def edge(side, row):
            return pa.RecordBatch.from_pylist([{"part": here, "edge": side, "k": row[0], "text": row[1]}], schema)

        for batch in batches:
            for piece in slices(batch):
                found = list(zip(piece.column("k").to_pylist(), piece.column("text").to_pylist()))
                if held is None:
                    yield edge("first", found[0])
                else:
                    found.insert(0, held)
                held = found[-1]
                if len(found) > 1:
                    done = _compared([k for k, _ in found[:-1]], [t for _, t in found[:-1]], [t for _, t in found[1:]])
                    n = len(found) - 1
                    yield pa.RecordBatch.from_pydict({"part": [here] * n, "edge": [None] * n, "text": [None] * n} | done, schema)
        if held is not None:
            yield edge("last", held)

    walked = checkpointed(dealt.mapInArrow(walk, f"part int, edge string, k {kind}, text string, {RESULT}"))
    first, last = (walked.where(F.col("edge") == side).select("part", F.col("k"), F.col("text")) for side in ("first", "last"))
    # One row per partition: which one follows, the first after the last.
    follows = first.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    heads = first.select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = last.join(follows, "part").join(heads, "next").select("k", "text", "following")

    def finish(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(_compared(*(batch.column(c).to_pylist() for c in ("k", "text", "following"))), pa.schema([f for f in schema if f.name not in ("part", "edge", "text")]))

    inner = walked.where(F.col("edge").isNull()).drop("part", "edge", "text")
    return inner.unionByName(ends.mapInArrow(finish, f"k {kind}, {RESULT}")).withColumnRenamed("k", key)


def dict_type(kind: str) -> pa.DataType:
    """The Arrow type of a key column."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_by_next(documents(spark, sf_dir))
