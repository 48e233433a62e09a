"""Katz backoff language model: Good-Turing discounted counts, backoff weights that normalise exactly.

Tokens are words (split at ASCII white space, A-Z lower-cased) and one end per text; the first token follows a start symbol. For a token w
after h:  p(w | h) = d(c(hw)) c(hw) / c(h) if hw was seen, else a(h) p(w);  p(w) = d(c(w)) c(w) / N if w was seen, else the mass that
discounting leaves at the bottom, for one unknown word. a(h) shares what the seen words of h leave among all others in proportion to p,
so each p(. | h) sums to 1 over the known words and the unknown one. Discounts follow Good and Turing up to a count of REACH; where the
counts of counts give no value in (0, 1), half a count is taken off. If nothing is left for unseen words, the total grows by one.

The counts live in tables by hash range ("shelves", see packed.py): words in the first, pairs by their first word in the second. A chunk
of texts sends its different words with their training counts, then its different pairs; a shelf adds up what the training texts
hold, and answers every chunk for the words and pairs it sent. So counting and looking up share one exchange, and nothing is
broadcast but a handful of totals. Two words are taken as one if their 64-bit hashes are equal.

Null and empty texts are the end alone. Repeated rows count as often as they occur. Without training rows every token is unknown with
probability 1. Only named columns are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm.common import Hasher, documents, fold, places, ranges
from fleetlake.llm.packed import Layout, layout, pack, pack_sorted, rows, unpack, unpack_sorted

REACH = 5
START, END = 0, 1  # their places among the 64-bit word hashes

ROW = pa.schema([("shelf", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("m", pa.int32()), *((c, pa.binary()) for c in "abcde")])
ROW_DDL = "shelf int, chunk int, n int, m int, a binary, b binary, c binary, d binary, e binary"
TOTALS = REACH + 3  # tokens, different ones, and how many occur 1, 2, ... REACH + 1 times


def totals(counts: np.ndarray) -> np.ndarray:
    return np.array([counts.sum(), (counts > 0).sum(), *(np.sum(counts == r) for r in range(1, REACH + 2))], np.int64)


def discounts(t: np.ndarray) -> np.ndarray:
    """The factor for counts 0 to REACH, then 1."""
    n = t[2:].astype(float)
    d = np.array([0.0, *((r - 0.5) / r for r in range(1, REACH + 1))])
    if n[0] > 0:
        common = (REACH + 1) * n[REACH] / n[0]
        for r in range(1, REACH + 1):
            if n[r - 1] > 0 and common < 1:
                value = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                d[r] = value if 0 < value < 1 else d[r]
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts > REACH, counts, d[np.minimum(counts, REACH)] * counts)


def words(counts: np.ndarray, t: np.ndarray) -> np.ndarray:
    """p(w) by the word's count; count 0 is the unknown word."""
    d, n = discounts(t), float(t[0])
    left = np.sum([r * (1 - d[r]) * t[1 + r] for r in range(1, REACH + 1)])
    if left <= 0:
        n, left = n + 1, 1.0
    return np.where(counts > 0, discounted(counts, d), left) / n


def pairs(count: np.ndarray, after: np.ndarray, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """p(w | h) by c(hw), h's figures (p(w) of its seen words added up, pairs that occur 1 to REACH times, tokens of all others) and p(w)."""
    d = discounts(t)
    r = np.arange(1, REACH + 1)
    total = after[:, 1:-1] @ r + after[:, -1]
    seen = after[:, 1:-1] @ (r * d[1:]) + after[:, -1]
    full = seen >= total * (1 - 1e-12)
    grown = total + full
    left = np.where(total > 0, (grown - seen) / np.maximum(grown, 1), 1.0)
    others = np.where(total > 0, 1 - after[:, 0], 1.0)
    return np.where(count > 0, discounted(count, d) / np.maximum(grown, 1), left / np.maximum(others, 1e-300) * p)


class Chunk:
    """A chunk's tokens as places in its own sorted vocabulary (start and end are its first two)."""

    def __init__(self, table: pa.Table):
        self.keys = table.column("k")
        self.train = np.array(table.column("train").to_pylist(), bool)
        hashes, counts = Hasher(lower=True).of_texts(table.column("text").to_pylist())
        sizes = counts + 2
        self.ends = np.cumsum(sizes)
        flat = np.full(int(sizes.sum()), END, np.uint64)
        flat[self.ends - sizes] = START
        flat[ranges(self.ends - sizes + 1, counts)] = hashes
        self.vocabulary, place = places(flat)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.zeros(len(flat), bool)
        self.first[self.ends - sizes] = True
        self.token = ~self.first  # all but the start symbols are predicted
        self.place, self.doc, self.sizes = place, doc, sizes
        self.counted = self.train[doc]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.place[self.token & self.counted], minlength=len(self.vocabulary))

    def word_pairs(self, plan: Layout, ids: np.ndarray, counts: np.ndarray, tokens: int) -> Pairs:
        """Different pairs in the order in which they are sent."""
        after = np.flatnonzero(self.token)
        rank = np.empty(len(ids), np.int64)
        by_id = np.argsort(ids)
        rank[by_id] = np.arange(len(ids))
        key, of = places(self.place[after - 1] * len(ids) + rank[self.place[after]], 2 * len(ids).bit_length())
        seen = np.bincount(of, weights=self.counted[after], minlength=len(key)).astype(np.int64)
        first, second = key // len(ids), by_id[key % len(ids)]
        # A frequent first word's pairs are dealt to as many shelves as its share of all tokens asks for, by the second word's id.
        shelves = 1 << plan.shelf_bits
        uses = np.where(np.arange(len(ids)) == 0, counts[1], counts)  # the start symbol occurs as often as the end
        salts = 1 << np.ceil(np.log2(np.clip(uses * shelves / max(tokens, 1), 1, shelves))).astype(np.int64)
        home = (self.vocabulary >> np.uint64(64 - plan.shelf_bits)).astype(np.int64)
        shelf = (home[first] + (ids[second] & (salts[first] - 1))) & (shelves - 1)
        order = np.argsort(shelf, kind="stable")  # inside a shelf by first word, then by the second's id
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        head = np.unique(first)
        heads = np.repeat(head, salts[head])
        head_shelf = (home[heads] + ranges(np.zeros(len(head), np.int64), salts[head])) & (shelves - 1)
        by_shelf = np.lexsort((heads, head_shelf))
        heads, head_shelf = heads[by_shelf], head_shelf[by_shelf]
        sizes = np.bincount(np.searchsorted(head_shelf * len(ids) + heads, (shelf * len(ids) + first)[order]), minlength=len(heads))
        return Pairs(first[order], second[order], seen[order], moved[of], shelf[order], heads, head_shelf, sizes)


@dataclass(frozen=True)
class Pairs:
    """Pairs of places in a chunk's vocabulary, and the first words with the shelves that hold some of their pairs."""

    first: np.ndarray
    second: np.ndarray
    seen: np.ndarray  # how often the training texts of the chunk have the pair
    of: np.ndarray  # the pair of every predicted token
    shelf: np.ndarray
    heads: np.ndarray
    head_shelf: np.ndarray
    sizes: np.ndarray  # of each head in its shelf

    def cuts(self) -> list[tuple[int, slice, slice]]:
        """(shelf, its pairs, its heads)."""
        shelves = np.unique(self.head_shelf)
        ends = [(np.searchsorted(x, shelves), np.searchsorted(x, shelves, side="right")) for x in (self.shelf, self.head_shelf)]
        return [(int(s), slice(a, b), slice(c, d)) for s, a, b, c, d in zip(shelves, *ends[0], *ends[1])]


def _row(out: dict[str, list], *values) -> None:
    for name, value in zip(ROW.names, values):
        out[name].append(value)


def _empty() -> dict[str, list]:
    return {n: [] for n in ROW.names}


def _send_words(plan: Layout, table: pa.Table) -> pa.Table:
    c, out = Chunk(table), _empty()
    counts = c.word_counts()
    for shelf, i, j in plan.cuts(c.vocabulary):
        _row(out, shelf, table.column("chunk")[0].as_py(), j - i, 0, pack_sorted(c.vocabulary[i:j]), pack(counts[i:j]), b"", b"", b"")
    return rows(ROW, out)


def _count_words(plan: Layout, table: pa.Table) -> pa.Table:
    """For every chunk the words' rank in the shelf and their counts; the shelf's totals as a row without a chunk."""
    sent = sorted(zip(*(table.column(x).to_pylist() for x in ("chunk", "shelf", "n", "a", "b"))), key=lambda x: x[0])
    keys = [unpack_sorted(a, n) for _, _, n, a, _ in sent]
    known, at = places(np.concatenate(keys))
    counts = np.zeros(len(known), np.int64)
    np.add.at(counts, at, np.concatenate([unpack(b, n) for _, _, n, _, b in sent]).astype(np.int64))
    out, offset = _empty(), 0
    for chunk, shelf, n, _, _ in sent:
        here = at[offset : offset + n]
        _row(out, shelf, chunk, n, 0, pack_sorted(here.astype(np.uint64)), pack(counts[here]), b"", b"", b"")
        offset += n
    _row(out, sent[0][1], -1, 0, 0, totals(counts).tobytes(), b"", b"", b"", b"")
    return rows(ROW, out)


def _told(said: pa.Table, number: int) -> dict[int, tuple]:
    """By shelf: n, m and the packed answers of a round."""
    columns = [said.column(x).to_pylist() for x in ("round", "shelf", "n", "m", *"abcde")]
    return {x[1]: x[2:] for x in zip(*columns) if x[0] == number}


def _word_facts(plan: Layout, c: Chunk, said: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and counts of the chunk's vocabulary, and the corpus totals."""
    told = _told(said, 0)
    ids, counts = [], []
    for shelf, i, j in plan.cuts(c.vocabulary):
        ids.append(unpack_sorted(told[shelf][2], j - i).astype(np.int64) << plan.shelf_bits | shelf)
        counts.append(unpack(told[shelf][3], j - i).astype(np.int64))
    return np.concatenate(ids), np.concatenate(counts), np.frombuffer(_told(said, 1)[-1][2], np.int64)


def _send_pairs(plan: Layout, table: pa.Table, said: pa.Table) -> pa.Table:
    """By shelf of the first word: its hash and how many pairs it begins; of each pair the second word's id and count and the training count."""
    c, out = Chunk(table), _empty()
    ids, counts, t = _word_facts(plan, c, said)
    found = c.word_pairs(plan, ids, counts, int(t[0]))
    for shelf, own, heads in found.cuts():
        second = found.second[own]
        packed = (pack_sorted(c.vocabulary[found.heads[heads]]), pack(found.sizes[heads]), pack(ids[second]), pack(counts[second]), t.tobytes() + pack(found.seen[own]))
        _row(out, shelf, table.column("chunk")[0].as_py(), len(second), heads.stop - heads.start, *packed)
    return rows(ROW, out)


def _count_pairs(plan: Layout, table: pa.Table) -> pa.Table:
    """For every chunk its pairs' counts and the figures of their first words; the shelf's totals as a row without a chunk."""
    sent = sorted(zip(*(table.column(x).to_pylist() for x in ROW.names)), key=lambda x: x[1])
    head = [unpack_sorted(a, m) for _, _, _, m, a, *_ in sent]
    t = np.frombuffer(sent[0][8][: 8 * TOTALS], np.int64)
    heads, head_at = places(np.concatenate(head))
    sizes = np.concatenate([unpack(b, m) for _, _, _, m, _, b, *_ in sent]).astype(np.int64)
    second = np.concatenate([unpack(x[6], x[2]) for x in sent]).astype(np.int64)
    p = words(np.concatenate([unpack(x[7], x[2]) for x in sent]).astype(np.int64), t)
    seen = np.concatenate([unpack(x[8][8 * TOTALS :], x[2]) for x in sent]).astype(np.int64)
    first = np.repeat(head_at, sizes)
    span = int(second.max()) + 1 if len(second) else 1
    _, at = places(first * span + second, (len(heads) * span).bit_length())
    one = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
    one[at] = np.arange(len(at))  # a place of every different pair
    counts = np.zeros(len(one), np.int64)
    np.add.at(counts, at, seen)
    owner, p = first[one], np.where(counts > 0, p[one], 0.0)
    figures = np.zeros((len(heads), REACH + 2))
    figures[:, 0] = np.bincount(owner, weights=p, minlength=len(heads))
    for r in range(1, REACH + 1):
        figures[:, r] = np.bincount(owner[counts == r], minlength=len(heads))
    figures[:, -1] = np.bincount(owner, weights=np.where(counts > REACH, counts, 0), minlength=len(heads))
    out, i, j = _empty(), 0, 0
    for shelf, chunk, n, m, *_ in sent:
        here = figures[head_at[j : j + m]]
        whole = pack(np.ascontiguousarray(here[:, 1:].T).astype(np.uint64).reshape(-1))
        _row(out, shelf, chunk, n, m, pack(counts[at[i : i + n]]), pack(np.ascontiguousarray(here[:, 0]).view(np.uint64)), whole, b"", b"")
        i, j = i + n, j + m
    _row(out, sent[0][0], -1, 0, 0, totals(counts).tobytes(), b"", b"", b"", b"")
    return rows(ROW, out)


RESULT = pa.schema([("k", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _evaluate(plan: Layout, table: pa.Table, said: pa.Table) -> pa.Table:
    c = Chunk(table)
    ids, counts, t = _word_facts(plan, c, said)
    found = c.word_pairs(plan, ids, counts, int(t[0]))
    told, pair_totals = _told(said, 2), np.frombuffer(_told(said, 3)[-1][2], np.int64)
    p, seen, figures = words(counts, t), np.zeros(len(found.first), np.int64), np.zeros((len(counts), REACH + 2))
    for shelf, own, heads in found.cuts():
        n, m, a, b, whole, _, _ = told[shelf]
        seen[own] = unpack(a, n)
        figures[found.heads[heads], 0] += unpack(b, m).view(np.float64)
        figures[found.heads[heads], 1:] += unpack(whole, m * (REACH + 1)).reshape(REACH + 1, m).T
    log = np.log10(pairs(seen, figures[found.first], p[found.second], pair_totals))
    base = np.log10((counts + 1) / (t[0] + t[1] + 1))
    place, doc, n = c.place[c.token], c.doc[c.token], len(c.sizes)
    return rows(RESULT, {
        "k": c.keys.to_pylist(), "n_tokens": c.sizes - 1, "n_known": np.bincount(doc[counts[place] > 0], minlength=n), "train_tokens": np.full(n, t[0]),
        "base_score": np.bincount(doc, weights=base[place], minlength=n), "score": np.bincount(doc, weights=log[found.of], minlength=n),
    })


def _to_all_chunks(answers: DataFrame, plan: Layout, number: int) -> DataFrame:
    """A round's answers, and its corpus totals (one row) for every chunk under the next number."""

    def add_up(table: pa.Table) -> pa.Table:
        t = np.sum([np.frombuffer(x, np.int64) for x in table.column("a").to_pylist()], axis=0)
        out = {n: [] for n in ["round", *ROW.names]}
        for chunk in range(plan.chunks):
            for name, value in zip(out, (number + 1, -1, chunk, 0, 0, t.tobytes(), b"", b"", b"", b"")):
                out[name].append(value)
        return pa.Table.from_pydict(out, pa.schema([("round", pa.int32()), *ROW]))

    whole = answers.where("chunk < 0").groupBy("chunk").applyInArrow(add_up, "round int, " + ROW_DDL)
    return answers.where("chunk >= 0").select(F.lit(number).alias("round"), *ROW.names).unionAll(whole)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of all rows, by a model of the rows where ``train`` is true."""
    plan = layout(docs, text)
    named = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    texts = named.select(F.pmod(F.xxhash64("k", "text"), F.lit(plan.chunks)).cast("int").alias("chunk"), "k", "text", "train")
    sent = texts.groupBy("chunk").applyInArrow(lambda t: _send_words(plan, t), ROW_DDL)
    known = _to_all_chunks(sent.groupBy("shelf").applyInArrow(lambda t: _count_words(plan, t), ROW_DDL), plan, 0)
    pair_rows = texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(lambda t, s: _send_pairs(plan, t, s), ROW_DDL)
    counted = _to_all_chunks(pair_rows.groupBy("shelf").applyInArrow(lambda t: _count_pairs(plan, t), ROW_DDL), plan, 2)
    done = texts.groupBy("chunk").cogroup(known.unionAll(counted).groupBy("chunk")).applyInArrow(
        lambda t, s: _evaluate(plan, t, s), "k long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 7) == 2
    done = score(documents(spark, sf_dir), ~held)
    return done.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
