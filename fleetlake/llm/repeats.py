"""Substring dedup with fixed-block anchors.

A repeat counts from LEAST words on. Whatever place a repeated window of 13 words has in another document, it covers a whole block
of 7 words that starts there at a multiple of 7. So every document's non-overlapping blocks are the reference index, and every
rolling run of 7 words of every document probes it (``anchors``). Hits are then extended: windows around a hit, and windows around a
block that others hit, meet by their 64-bit hash (``owners``), and a window whose words also start in a document with a smaller
key is covered; joined, covered windows are the maximal repeats.

Probes and blocks are hashes shortened to the size of the corpus, so a few chance hits pass the anchors; they are undone by the full window
hash. Windows are judged on the input. Equal keys are the same document to each other: neither is smaller. Null keys are
smaller than all others. Null and empty texts have no words. Only named columns are returned.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm.common import Hasher, distinct, documents, places, window_hashes
from fleetlake.llm.packed import Layout, bits, chunked, layout, pack, pack_sorted, rows, unbits, unpack, unpack_sorted

LEAST = 13
BLOCK = 7
NONE = np.iinfo(np.int64).min

SENT = pa.schema([("shelf", pa.int32()), ("chunk", pa.int32()), ("n_a", pa.int32()), ("a", pa.binary()), ("n_b", pa.int32()), ("b", pa.binary())])
SENT_DDL = "shelf int, chunk int, n_a int, a binary, n_b int, b binary"
SAID = pa.schema([("chunk", pa.int32()), ("round", pa.int32()), ("shelf", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
SAID_DDL = "chunk int, round int, shelf int, a binary, b binary"


class Words:
    """The words of a chunk's documents (in key order) and where their runs start."""

    def __init__(self, table: pa.Table, least: int, block: int):
        order = np.argsort(np.array([NONE if k is None else k for k in table.column("k").to_pylist()], np.int64), kind="stable")
        self.order, keys, texts = order, table.column("k").to_pylist(), table.column("text").to_pylist()
        self.raw_keys = [keys[i] for i in order]
        self.keys = np.array([NONE if k is None else k for k in self.raw_keys], np.int64)
        self.texts = [texts[i] or b"" for i in order]
        h, sizes = Hasher(lower=False).of_texts(self.texts)
        self.sizes = sizes
        self.begins = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.n, self.least, self.block, self.h = len(h), least, block, h
        room = (self.begins + sizes)[self.doc] - np.arange(self.n) if self.n else np.zeros(0, np.int64)
        self.fits = room >= least  # a window starts here
        self.block_fits = room >= block
        self.aligned = self.block_fits & ((np.arange(self.n) - self.begins[self.doc]) % block == 0) if self.n else np.zeros(0, bool)

    def short(self, width: int) -> np.ndarray:
        """Shortened hash of the block that starts at each word (meaningless where none fits)."""
        out = np.zeros(self.n, np.uint64)
        found = window_hashes(self.h, self.block)
        out[: len(found)] = found >> np.uint64(64 - width)
        return out

    def long(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint64)
        found = window_hashes(self.h, self.least)
        out[: len(found)] = found
        return out


def _send(plan: Layout, chunk: int, a: np.ndarray, b: np.ndarray, width: int) -> pa.Table:
    """Two sorted key sets of a chunk, by shelf."""
    left, right = ({s: (x, y) for s, x, y in plan.cuts(keys, width)} for keys in (a, b))
    out: dict[str, list] = {n: [] for n in SENT.names}
    for shelf in sorted({*left, *right}):
        (i, j), (p, q) = left.get(shelf, (0, 0)), right.get(shelf, (0, 0))
        for name, value in zip(SENT.names, (shelf, chunk, j - i, pack_sorted(a[i:j]), q - p, pack_sorted(b[p:q]))):
            out[name].append(value)
    return rows(SENT, out)


def _anchors(table: pa.Table) -> pa.Table:
    """Which probes of a chunk meet a block of another chunk, and which of its blocks another chunk's probes meet."""
    sent = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "shelf", "n_a", "a", "n_b", "b"))), key=lambda x: x[0])
    blocks = [unpack_sorted(b, n) for _, _, _, _, n, b in sent]
    owner = np.repeat([x[0] for x in sent], [len(b) for b in blocks])
    known, at = places(np.concatenate(blocks))
    first, last = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), -1)
    np.minimum.at(first, at, owner)
    np.maximum.at(last, at, owner)
    met, answers, offset = np.zeros(len(known), np.int64), [], 0
    for chunk, shelf, n, a, _, _ in sent:
        probes = unpack_sorted(a, n)
        i = np.minimum(np.searchsorted(known, probes), max(len(known) - 1, 0))
        found = known[i] == probes if len(known) else np.zeros(n, bool)
        met[i[found]] += 1
        answers.append(found & ((first[i] != chunk) | (last[i] != chunk)) if len(known) else found)
    out: dict[str, list] = {n: [] for n in SAID.names}
    for (chunk, shelf, *_), hit, own in zip(sent, answers, blocks):
        active = met[at[offset : offset + len(own)]] > 1  # its own probes meet every block once
        offset += len(own)
        for name, value in zip(SAID.names, (chunk, 0, shelf, bits(hit), bits(active))):
            out[name].append(value)
    return rows(SAID, out)


def _owners(table: pa.Table) -> pa.Table:
    """For each window of a chunk: whether a document before the chunk's first one with that window has it too."""
    sent = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "shelf", "n_a", "a", "b"))), key=lambda x: x[0])
    keys = np.concatenate([unpack_sorted(a, n) for _, _, n, a, _ in sent])
    docs = np.concatenate([unpack(b, n) for _, _, n, _, b in sent]).view(np.int64)
    known, at = places(keys)
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, at, docs)
    earlier = least[at] < docs
    out: dict[str, list] = {n: [] for n in SAID.names}
    offset = 0
    for chunk, shelf, n, _, _ in sent:
        for name, value in zip(SAID.names, (chunk, 1, shelf, bits(earlier[offset : offset + n]), b"")):
            out[name].append(value)
        offset += n
    return rows(SAID, out)


def _answers(plan: Layout, keys: np.ndarray, said: dict[int, bytes], width: int) -> np.ndarray:
    """The flags of all shelves, in the order of the sorted keys."""
    return np.concatenate([unbits(said[s], j - i) for s, i, j in plan.cuts(keys, width)]) if len(keys) else np.zeros(0, bool)


def _candidates(w: Words, plan: Layout, said: dict[int, tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a chunk that touch an anchor: their starts, and of each different hash: the hash, its windows' index, its first document's key."""
    short = w.short(plan.filter_bits)
    probes, at = places(short[w.block_fits], plan.filter_bits)
    blocks, of = places(short[w.aligned], plan.filter_bits)
    hit, active = np.zeros(w.n, bool), np.zeros(w.n, bool)
    hit[w.block_fits] = _answers(plan, probes, {s: x for s, (x, _) in said.items()}, plan.filter_bits)[at]
    active[w.aligned] = _answers(plan, blocks, {s: y for s, (_, y) in said.items()}, plan.filter_bits)[of]
    if len(blocks):  # documents of this chunk among themselves
        owner, first, last = w.doc[w.aligned], np.full(len(blocks), w.n), np.full(len(blocks), -1)
        np.minimum.at(first, of, owner)
        np.maximum.at(last, of, owner)
        i = np.minimum(np.searchsorted(blocks, short), len(blocks) - 1)
        local = w.block_fits & (blocks[i] == short) & ((first[i] != w.doc) | (last[i] != w.doc))
        hit |= local
        touched = np.zeros(len(blocks), bool)
        touched[i[local]] = True
        active[w.aligned] |= touched[of]
    anchor = np.flatnonzero(hit | active)
    near = np.zeros(w.n + 1, np.int64)  # a window that starts up to LEAST - BLOCK words before an anchor holds it whole
    np.add.at(near, np.maximum(anchor - (w.least - w.block), 0), 1)
    np.add.at(near, anchor + 1, -1)
    starts = np.flatnonzero((np.cumsum(near)[:-1] > 0) & w.fits)
    keys, of = places(w.long()[starts])
    first = np.full(len(keys), w.n, np.int64)
    np.minimum.at(first, of, starts)
    return starts, keys, of, w.keys[w.doc[first]]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_words, n_removed, kept): every text without the words that a smaller key's document has in a run of ``least`` words."""
    block = (least + 1) // 2
    plan = layout(docs, text)
    texts = chunked(docs, plan, key, text)
    width = plan.filter_bits

    def first_round(table: pa.Table) -> pa.Table:
        w = Words(table, least, block)
        short = w.short(width)
        return _send(plan, table.column("chunk")[0].as_py(), distinct(short[w.block_fits]), distinct(short[w.aligned]), width)

    def of_round(said: pa.Table, number: int) -> dict[int, tuple[bytes, bytes]]:
        return {s: (a, b) for r, s, a, b in zip(*(said.column(c).to_pylist() for c in ("round", "shelf", "a", "b"))) if r == number}

    def second_round(table: pa.Table, said: pa.Table) -> pa.Table:
        w = Words(table, least, block)
        _, keys, _, owners = _candidates(w, plan, of_round(said, 0))
        out: dict[str, list] = {n: [] for n in SENT.names}
        for shelf, i, j in plan.cuts(keys):
            for name, value in zip(SENT.names, (shelf, table.column("chunk")[0].as_py(), j - i, pack_sorted(keys[i:j]), 0, pack(owners[i:j].view(np.uint64)))):
                out[name].append(value)
        return rows(SENT, out)

    result = pa.schema([("k", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def last_round(table: pa.Table, said: pa.Table) -> pa.Table:
        w = Words(table, least, block)
        starts, keys, of, owners = _candidates(w, plan, of_round(said, 0))
        earlier = _answers(plan, keys, {s: a for s, (a, _) in of_round(said, 1).items()}, 64)
        found = starts[earlier[of] | (owners[of] < w.keys[w.doc[starts]])] if len(starts) else starts
        cover = np.zeros(w.n + 1, np.int64)
        cover[found] += 1
        np.add.at(cover, found + least, -1)
        kept = np.cumsum(cover)[:-1] == 0
        out: dict[str, list] = {n: [] for n in result.names}
        for k, words, start, size in zip(w.raw_keys, map(bytes.split, w.texts), w.begins, w.sizes):
            here = kept[start : start + size]
            left = words if here.all() else list(compress(words, here.tolist()))
            for name, value in zip(result.names, (k, len(words), len(words) - len(left), b" ".join(left).decode())):
                out[name].append(value)
        return rows(result, out)

    sent = texts.groupBy("chunk").applyInArrow(first_round, SENT_DDL)
    said = sent.groupBy("shelf").applyInArrow(_anchors, SAID_DDL)
    windows = texts.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(second_round, SENT_DDL)
    both = said.unionAll(windows.groupBy("shelf").applyInArrow(_owners, SAID_DDL))
    done = texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(last_round, "k long, n_words long, n_removed long, kept string")
    return done.withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
