"""Byte-level BPE encoding and decoding, merged for many words at once.

The symbols of all new words of a slice lie in one flat array. In every round the rank of each neighbouring pair is found by
binary search over the sorted pair keys, every word merges all occurrences of its lowest-ranked pair (left to right, without
overlap), and words without a known pair leave the array. This equals merging one pair at a time whenever a merge that uses
a symbol ranks behind the merge that makes it, which holds for trained merge lists and is checked when the file is read.
A word takes a round for every rank that occurs in it, so words of more than LONG bytes stay out of the array: their merges come one by
one from a heap of (rank, place) over linked symbols, and cost the word's length times its logarithm.

Null text is empty text: no ids, decoded to the empty text. Rows with equal ids are kept as they are. Only the id column and the
result columns are returned, so other columns of the input cannot clash.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm.common import documents, ranges, slices

# The splitting pattern of byte-level BPE and the bytes that stand for themselves in vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = 2048  # bytes of a word beyond which rounds over the whole array would cost more than single merges


def byte_of_symbol() -> dict[str, int]:
    """Vocabulary files write bytes as visible characters: printable ones as themselves, the others from U+0100 on."""
    shown = {b for span in PRINTABLE for b in span}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def read_tables(path: str) -> dict:
    """The vocabulary as arrays; sized by the file alone (about 3 MB for 50,000 merges)."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    to_byte, vocab = byte_of_symbol(), file["model"]["vocab"]
    added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    words = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for symbol, i in vocab.items():
        words[i] = bytes(to_byte[c] for c in symbol)
    for symbol, i in added.items():
        words[i] = symbol.encode()
    size = len(words)
    left, right, made = [], [], []
    for pair in file["model"]["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        left.append(vocab[a])
        right.append(vocab[b])
        made.append(vocab[a + b])
    made_at = dict(reversed([(m, r) for r, m in enumerate(made)]))
    if any(made_at.get(s, -1) >= r for r, (a, b) in enumerate(zip(left, right)) for s in (a, b)):
        raise ValueError("a merge uses a symbol before it is made; rounds would not equal single merges")
    keys = np.array(left, np.int64) * size + np.array(right, np.int64)
    order = np.argsort(keys, kind="stable")
    lengths = np.array([len(w) for w in words], np.int64)
    return {
        "size": size, "keys": keys[order], "ranks": order.astype(np.int64), "made": np.array(made, np.int64)[order],
        "of_byte": np.array([vocab[s] for s, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int64),
        "bytes": np.frombuffer(b"".join(words), np.uint8), "lengths": lengths, "starts": np.cumsum(lengths) - lengths, "added": added,
    }


class Codec:
    """Encodes and decodes lists of texts; pieces seen before are remembered, up to ``most`` of them."""

    def __init__(self, tables: dict, most: int = 300_000):
        self.t = tables
        self.most, self.known = most, None
        self.split = regex.compile(PATTERN, regex.V0)
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(tables["added"], key=len, reverse=True))) if tables["added"] else None
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.lengths = np.zeros(1 << 14, np.int64)
        self.starts = np.zeros(1 << 14, np.int64)

    def remember(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self.slot), len(pieces)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + n > len(self.lengths):
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[first : first + n] = lengths
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.slot.update(zip(pieces, range(first, first + n)))

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        raw = [p.encode() for p in pieces]
        long = {i: self.merge_long(r) for i, r in enumerate(raw) if len(r) > LONG}
        if not long:
            return self.merge_rounds(raw)
        ids, counts = self.merge_rounds([r for i, r in enumerate(raw) if i not in long])
        ends, out, sizes, short = np.append(0, np.cumsum(counts)), [], [], 0
        for i in range(len(raw)):
            if i in long:
                out.append(long[i])
            else:
                out.append(ids[ends[short] : ends[short + 1]])
                short += 1
            sizes.append(len(out[-1]))
        return np.concatenate(out).astype(np.uint32), np.array(sizes, np.int64)

    def merge_long(self, raw: bytes) -> np.ndarray:
        """Ids of one long word: always the lowest rank first, the leftmost of equal ones."""
        t = self.t
        if self.known is None:
            self.known = {k: (r, m) for k, r, m in zip(t["keys"].tolist(), t["ranks"].tolist(), t["made"].tolist())}
        known, size = self.known, t["size"]
        sym = t["of_byte"][np.frombuffer(raw, np.uint8)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, a, b) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (found := known.get(a * size + b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:  # one of the two is merged already
                continue
            sym[i], sym[j] = known[a * size + b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := known.get(sym[i] * size + sym[k]):
                    heapq.heappush(heap, (found[0], i, sym[i], sym[k]))
            if (h := before[i]) >= 0 and (found := known.get(sym[h] * size + sym[i])):
                heapq.heappush(heap, (found[0], h, sym[h], sym[i]))
        return np.array([x for x in sym if x >= 0], np.uint32)

    def merge_rounds(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short words at once."""
        t = self.t
        counts = np.array([len(r) for r in raw], np.int64)
        sym = t["of_byte"][np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), counts)
        done_ids, done_words = [], []
        none = len(t["keys"])
        while len(sym):
            key = sym[:-1] * t["size"] + sym[1:]
            at = np.minimum(np.searchsorted(t["keys"], key), none - 1)
            known = (t["keys"][at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, t["ranks"][at], none), none)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(begins, len(word)))
            lowest = np.minimum.reduceat(rank, begins)
            active = np.repeat(lowest < none, sizes)
            hit = (rank == np.repeat(lowest, sizes)) & active
            spots = np.flatnonzero(hit)
            if len(spots):  # neighbouring hits (a pair of equal symbols) are taken from the left, every second one
                new_run = np.append(True, np.diff(spots) > 1)
                start = np.maximum.accumulate(np.where(new_run, np.arange(len(spots)), 0))
                spots = spots[(np.arange(len(spots)) - start) % 2 == 0]
                sym[spots] = t["made"][at[spots]]
            keep = active.copy()
            keep[spots + 1] = False
            if not active.all():
                done_ids.append(sym[~active])
                done_words.append(word[~active])
            sym, word = sym[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.uint32), counts
        ids, words = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(words, minlength=len(raw)).astype(np.int64)

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.split.findall(text[at : m.start()])
            out.append("\0" + m.group())  # no piece of a text starts with NUL and goes on with "<"
            at = m.end()
        return out + self.split.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.slot) > self.most:
            self.forget()
        split = [self.pieces(x) for x in texts]
        flat = [p for pieces in split for p in pieces]
        fresh = [p for p in dict.fromkeys(flat) if p not in self.slot]
        marks = {"\0" + k: v for k, v in self.t["added"].items()}
        special = [p for p in fresh if p in marks]
        if special:
            self.remember(special, np.array([marks[p] for p in special], np.uint32), np.ones(len(special), np.int64))
            fresh = [p for p in fresh if p not in marks]
        if fresh:
            self.remember(fresh, *self.merge(fresh))
        slot = self.slot
        slots = np.array([slot[p] for p in flat], np.int64)
        lengths = self.lengths[slots]
        ids = self.ids[ranges(self.starts[slots], lengths)]
        ends = np.cumsum([len(p) for p in split], dtype=np.int64)
        upto = np.append(0, np.cumsum(lengths))
        return ids, np.diff(np.append(0, upto[ends]))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive id runs; bytes that are not UTF-8 become U+FFFD."""
        t, i = self.t, ids.astype(np.int64)
        lengths = t["lengths"][i]
        flat = t["bytes"][ranges(t["starts"][i], lengths)].tobytes()
        upto = np.append(0, np.cumsum(lengths))
        cuts = upto[np.append(0, np.cumsum(counts))].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def _packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(counts) * 4)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids): ids as little-endian unsigned 32-bit integers, one after the other."""
    return _run(docs, tokenizer, key, text, decoded=False)


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): the encoded text and what its ids decode to, in one pass."""
    return _run(docs, tokenizer, key, text, decoded=True)


def _run(docs: DataFrame, tokenizer: str, key: str, text: str, decoded: bool) -> DataFrame:
    tables = docs.sparkSession.sparkContext.broadcast(read_tables(tokenizer))  # sized by the vocabulary file

    def run(batches):
        codec = Codec(tables.value)
        for batch in batches:
            for part in slices(batch):
                ids, counts = codec.encode([x or "" for x in part.column("text").to_pylist()])
                columns = [part.column("k"), pa.array(counts), _packed(ids, counts)]
                names = ["k", "n_tokens", "ids"]
                if decoded:
                    columns.append(pa.array(codec.decode(ids, counts), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    schema = f"k {rows.schema['k'].dataType.simpleString()}, n_tokens long, ids binary" + ", decoded string" * decoded
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def decode(rows: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of packed ids; null ids decode to the empty text."""
    tables = rows.sparkSession.sparkContext.broadcast(read_tables(tokenizer))

    def run(batches):
        codec = Codec(tables.value)
        for batch in batches:
            for part in slices(batch, "ids"):
                each = [np.frombuffer(x or b"", "<u4") for x in part.column("ids").to_pylist()]
                texts = codec.decode(np.concatenate(each) if each else np.zeros(0, np.uint32), np.array([len(x) for x in each], np.int64))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(texts, pa.string())], ["k", "decoded"])

    packed = rows.select(F.col(key).alias("k"), F.col(ids).alias("ids"))
    return packed.mapInArrow(run, f"k {packed.schema['k'].dataType.simpleString()}, decoded string").withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(documents(spark, sf_dir))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
