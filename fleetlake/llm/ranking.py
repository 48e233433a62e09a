"""Ranked lexical search: each item's best documents, found by the mask of the item's terms that a document holds.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased. A term's weight w is
floor(1000*ln((2N+2)/(2df+1))), N the documents with a term, df those that hold the term. With n terms in a document, L in all and
m = 50 + (50*n*N) div L, a term that occurs tf times gains w * ((10^9*tf) div (1000*tf+20*m)). A document's score is the sum over the
item's different terms.

 1. One pass over the texts counts each document's terms and keeps the occurrences of terms that some item asks for (``postings``, one
    row per document, checkpointed). N, L and df are aggregates of these rows.
 2. A task walks its postings in blocks of bounded size. For every item, each term's documents are a bitmap that is or-ed into the documents' presence
    masks; documents with equal masks make one group. The largest gain of every term in the block bounds the score of a mask;
    masks are evaluated by falling bound until the next bound lies below the score of the last place. What a task found so
    far stays the measure in its next block. Ties at the last place are never cut off by a bound.
 3. The tasks' best rows of an item meet in a salted ranking and then in a final one.

No key is shuffled but those best rows, so frequent terms, copies and hot sources make no hot task. Items are taken in blocks
of ITEM_BYTES of text: a block's terms are what goes to the tasks, and every block is one pass over the documents (one pass up to 4 MB of items).
Two words count as equal if their 64-bit hashes are (chance: different words of the corpus times terms of the items over 1.8e19).

Defined results: null and empty texts, and texts without a term, are in no count and on no list. Rows without a key are counted but not ranked.
Rows that occur twice count and rank as two documents. Rows of one item id are one item; items without an id or a term have no
rows. Equal scores rank by ascending key. An empty table of either kind gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import Hasher, checkpointed, documents, parts, ranges, slices

TOP = 50
ITEM_BYTES = 4 << 20
BLOCK_POSTINGS = 2 << 20  # of a task at a time: 16 bytes each, and as many again while a block is sorted
TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def terms(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").translate(LOWER)))


def term_hasher() -> Hasher:
    """Hashes of the words between all ASCII characters but letters and digits."""
    hasher, byte = Hasher(lower=True), np.arange(256)
    hasher.white = (byte < 128) & ~((byte >= 48) & (byte <= 57) | (byte >= 65) & (byte <= 90) | (byte >= 97) & (byte <= 122))
    return hasher


class Vocabulary:
    """The terms of a block of items: sorted hashes, and each item's terms as places among them."""

    def __init__(self, items: list[tuple]):
        asked: dict = {}
        for key, text in items:
            asked.setdefault(key, set()).update(terms(text))
        asked = {k: sorted(t) for k, t in asked.items() if t}
        words = sorted(set().union(*asked.values())) if asked else []
        hashes = term_hasher().of_texts([w.encode() for w in words])[0]
        order = np.argsort(hashes)
        place = {words[o]: i for i, o in enumerate(order.tolist())}
        self.hashes, self.size = hashes[order], len(words)
        self.items = [(k, np.array([place[w] for w in t], np.int64)) for k, t in asked.items()]


def postings(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, n, terms, tfs) of every document with a term: how many it has, and which of the vocabulary occur how often."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").cast("binary").alias("text"))
    kind, sent, size = rows.schema["k"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(vocabulary.hashes), vocabulary.size

    def run(batches):
        hasher, known = term_hasher(), sent.value
        for batch in batches:
            for part in slices(batch):
                hashes, counts = hasher.of_texts(part.column("text").to_pylist())
                at = np.minimum(np.searchsorted(known, hashes), size - 1)
                hit = known[at] == hashes
                doc = np.repeat(np.arange(len(counts)), counts)[hit]
                pairs, tf = np.unique(doc * size + at[hit], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(counts) + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (pairs % size, tf)]
                found = pa.RecordBatch.from_arrays([part.column("k"), pa.array(counts.astype(np.int64)), *lists], ["k", "n", "terms", "tfs"])
                yield found.filter(pa.array(counts > 0))

    return rows.mapInArrow(run, f"k {kind}, n long, terms array<int>, tfs array<int>")


class Ranker:
    """The best documents of every item among the blocks seen so far."""

    def __init__(self, items: list[tuple], weights: np.ndarray, documents: int, total: int, top: int):
        self.items, self.weights, self.documents, self.total, self.top = items, weights, documents, total, top
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        self.evaluated = 0

    def block(self, keys: np.ndarray, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Takes in documents: their keys and numbers of terms, and document d's terms between ends[d] and ends[d + 1]."""
        m = 50 + 50 * n * self.documents // self.total
        doc = np.repeat(np.arange(len(keys)), np.diff(ends))
        gain = self.weights[term] * (10**9 * tf // (1000 * tf + 20 * m[doc]))
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(self.weights) + 1))
        holders, largest = doc[order], np.zeros(len(self.weights), np.int64)
        np.maximum.at(largest, term, gain)
        asked = np.zeros(len(self.weights), bool)
        for i, (_, wanted) in enumerate(self.items):
            wanted = wanted[(starts[wanted + 1] > starts[wanted]) & (largest[wanted] > 0)]
            if len(wanted):
                asked[wanted] = True
                self.best[i] = self.search(self.best[i], keys, wanted, starts, holders, largest, lambda docs: self.scores(docs, ends, term, gain, asked))
                asked[wanted] = False

    def scores(self, docs, ends, term, gain, asked) -> np.ndarray:
        """Sums of the gains of the terms asked for, document by document."""
        self.evaluated += len(docs)
        sizes = ends[docs + 1] - ends[docs]
        at, owner = ranges(ends[docs], sizes), np.repeat(np.arange(len(docs)), sizes)
        held = asked[term[at]]
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, owner[held], gain[at[held]])
        return out

    def search(self, best, keys, wanted, starts, holders, largest, scores):
        masks = np.zeros((len(keys), -(-len(wanted) // 64)), np.uint64)
        for j, t in enumerate(wanted.tolist()):
            masks[holders[starts[t] : starts[t + 1]], j // 64] |= np.uint64(1 << j % 64)
        present = np.flatnonzero(masks.any(axis=1))
        groups, member = grouped(masks[present])
        bound = bounds(groups, largest[wanted])
        by_bound = np.argsort(-bound, kind="stable")
        place = np.empty(len(by_bound), np.int64)
        place[by_bound] = np.arange(len(by_bound))
        line = np.argsort(place[member], kind="stable")  # documents, mask after mask
        last = np.cumsum(np.bincount(place[member], minlength=len(by_bound)))  # where each mask's documents end
        at = mask = 0
        while mask < len(by_bound) and bound[by_bound[mask]] >= (best[0][-1] if len(best[0]) == self.top else 1):
            mask = int(np.searchsorted(last, min(at + 4 * self.top, last[-1]))) + 1  # whole masks, some documents at a time
            docs = present[line[at : last[mask - 1]]]
            best, at = self.merged(best, scores(docs), keys[docs]), int(last[mask - 1])
        return best

    def merged(self, best, scores, keys):
        """The first places of both lists, highest score first, then smallest key."""
        if len(best[0]) == self.top:
            near = scores >= best[0][-1]
            scores, keys = scores[near], keys[near]
        scores, keys = (np.concatenate([best[0], scores]), np.concatenate([best[1], keys])) if len(best[0]) else (scores, keys)
        order = np.argsort(keys, kind="stable")
        order = order[np.argsort(-scores[order], kind="stable")][: self.top]
        return scores[order], keys[order]


def grouped(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different masks and which one each row has."""
    if masks.shape[1] == 1:
        found, member = np.unique(masks[:, 0], return_inverse=True)
        return found[:, None], member
    found, member = np.unique(masks, axis=0, return_inverse=True)
    return found, member.reshape(-1)


def bounds(masks: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Sum of the largest gains of the terms in each mask, a byte of the mask at a time."""
    flat = np.ascontiguousarray(masks.astype("<u8")).view(np.uint8).reshape(len(masks), -1)
    bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
    out = np.zeros(len(masks), np.int64)
    for b in range(-(-len(largest) // 8)):
        part = largest[8 * b : 8 * b + 8]
        out += (bits[:, : len(part)] @ part)[flat[:, b]]
    return out


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """Items in blocks of about ITEM_BYTES of text; all rows of an item are in one block."""
    rows = items.select(F.col(key).alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    count = parts(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0, ITEM_BYTES)
    for block in range(count):
        yield [(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(count)) == block).toLocalIterator()]


def _searcher(vocabulary: Vocabulary, weights: np.ndarray, documents: int, total: int, top: int, types: tuple[pa.DataType, pa.DataType]):
    def run(batches):
        ranker = Ranker(vocabulary.items, weights, documents, total, top)
        held: list[pa.RecordBatch] = []

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = [rows.column(c).combine_chunks() for c in ("terms", "tfs")]
            sizes = np.asarray(pa.compute.list_value_length(lists[0]), np.int64)
            term, tf = (np.asarray(x.flatten(), np.int64) for x in lists)
            ranker.block(rows.column("k").to_numpy(), np.asarray(rows.column("n"), np.int64), np.concatenate([[0], np.cumsum(sizes)]), term, tf)
            held.clear()

        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column("k")))
            if batch.num_rows:
                held.append(batch)
            if sum(len(b.column("terms").flatten()) for b in held) > BLOCK_POSTINGS:
                flush()
        if held:
            flush()
        for (item, _), (scores, keys) in zip(vocabulary.items, ranker.best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(scores), types[1]), pa.array(keys, types[0]), pa.array(scores)], ["i", "k", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_key, rank, key, score): each item's ``top`` best documents with a score above 0."""
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    types = docs.select(key).limit(0).toArrow().schema.field(0).type, items.select(item_key).limit(0).toArrow().schema.field(0).type
    found = None
    for block in _blocks(items, item_key, item_text):
        vocabulary = Vocabulary(block)
        if not vocabulary.size:
            continue
        held = checkpointed(postings(docs, vocabulary, key, text))
        count, total = held.agg(F.count("*"), F.sum("n")).first()
        if not count:
            continue
        # One row per term of the block: bounded as the block is.
        df = F.count("*").alias("df")
        weight = F.floor(1000 * F.log((2.0 * count + 2) / (2 * F.col("df") + 1))).alias("w")
        weights = np.zeros(vocabulary.size, np.int64)
        for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(df).select("t", weight).toLocalIterator():
            weights[r["t"]] = r["w"]
        # Frequent searches leave as many rows an item as there are tasks times places: a salted ranking first, so that no item's rows meet in one task.
        salts = max(1, math.isqrt(held.rdd.getNumPartitions()))
        best = held.mapInArrow(_searcher(vocabulary, weights, count, total, top, types), f"i {kinds[1]}, k {kinds[0]}, score long")
        found = best.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts))) if found is None else found.unionAll(best.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts))))
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"i {kinds[1]}, k {kinds[0]}, score long, salt long")
    order = (F.desc("score"), F.asc("k"))
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("i", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return (
        near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(*order))).where(F.col("rank") <= top)
        .select(F.col("i").alias(item_key), "rank", F.col("k").alias(key), "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
