"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage of a document in up to k = m // SPAN edits (insertions, deletions, replacements).
Cut into k + 1 pieces, at least one piece is then untouched. All pieces are looked for at once by an Aho-Corasick automaton; every hit names
the place where its item would lie. Pieces belong to larger parts with errors of their own; Myers' bit-parallel edit distance is taken
of the smallest part around a hit first, of larger ones while that holds, and of the whole item against that place at last.

Texts and items are compared in lower case, with runs of white space as one blank; places are offsets into that form. Items are a bounded
set that is checked: they are dealt to blocks of BLOCK_CHARS characters, and each block is one automaton and one pass over the documents.
A document may match many items; each pair is returned once, with its smallest distance (then its first place).

Null or empty texts match nothing and null or blank items are matched by nothing. Items of fewer than LEAST characters match exactly and as
whole words only (no letter or digit beside them), since a few letters lie inside many words.
Repeated items give repeated pairs, repeated rows repeated results. ``matches`` returns named columns only; ``clean`` keeps the input's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm.common import documents, parts, slices, total_chars

SPAN = 10
LEAST = 20
BLOCK_CHARS = 4 << 20


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(start: int, end: int, errors: int, above: tuple = ()) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, enclosing parts with their errors, from the smallest up) of errors + 1 pieces.

    A part with e errors is cut in two that share e - 1: one of them keeps within its own. So if the whole item does, some
    piece is untouched and every part around it keeps within its errors.
    """
    if not errors:
        yield start, end, above
        return
    left = (errors - 1) // 2
    cut = start + (end - start) * (left + 1) // (errors + 1)
    inside = ((start, end, errors), *above)
    yield from pieces(start, cut, left, inside)
    yield from pieces(cut, end, errors - 1 - left, inside)


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.size = len(item)
        self.ones, self.high = (1 << self.size) - 1, 1 << (self.size - 1)
        self.where: dict[str, int] = {}
        for i, c in enumerate(item):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Smallest distance of the item to any substring, and the first end of such a substring."""
        ones, high, where = self.ones, self.high, self.where
        up, down, score = ones, 0, self.size
        least, end = score, 0
        for i, c in enumerate(text, 1):
            eq = where.get(c, 0)
            x = eq | down
            diagonal = ((((x & up) + up) ^ up) | x) & ones
            rise = down | ~(diagonal | up)
            fall = up & diagonal
            if rise & high:
                score += 1
            elif fall & high:
                score -= 1
                if score < least:
                    least, end = score, i
            rise = rise << 1 & ones
            fall = fall << 1 & ones
            up = (fall | ~(diagonal | rise)) & ones
            down = rise & diagonal
        return least, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], span: int = SPAN):
        import ahocorasick

        self.items = [(i, p) for i, t in items if (p := plain(t))]
        self.errors = [len(p) // span if len(p) >= LEAST else 0 for _, p in self.items]
        self.patterns: dict[tuple[int, int, int], Pattern] = {}
        self.automaton, places = ahocorasick.Automaton(), {}
        for n, (_, p) in enumerate(self.items):
            for start, end, around in pieces(0, len(p), self.errors[n]):
                places.setdefault(p[start:end], []).append((n, end - 1, around))
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()

    def pattern(self, n: int, start: int, end: int) -> Pattern:
        found = self.patterns.get((n, start, end))
        if found is None:
            found = self.patterns[n, start, end] = Pattern(self.items[n][1][start:end])
        return found

    def likely(self, text: str, n: int, zero: int, around: tuple) -> bool:
        """Whether all parts around a hit, but the whole item, keep within their errors where the item would begin at ``zero``."""
        for start, end, errors in around[:-1]:
            window = text[max(0, zero + start - errors) : max(0, zero + end + errors)]
            if self.pattern(n, start, end).best(window)[0] > errors:
                return False
        return True

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of every item that the text holds."""
        text, spots = plain(text), {}
        if not text or not self.items:
            return
        for at, where in self.automaton.iter(text):
            for n, last, around in where:
                if at - last not in spots.get(n, ()) and self.likely(text, n, at - last, around):
                    spots.setdefault(n, set()).add(at - last)
        for n in sorted(spots):
            if (found := self.verified(text, n, sorted(spots[n]))) is not None:
                yield self.items[n][0], *found

    def verified(self, text: str, n: int, starts: list[int]) -> tuple[int, int, int] | None:
        """Smallest distance of the item near the given starts, with its first place; nothing beyond its errors."""
        item, errors, best = self.items[n][1], self.errors[n], None
        for s in starts:
            if s >= 0 and text.startswith(item, s) and (len(item) >= LEAST or _apart(text, s, s + len(item))):
                return 0, s, s + len(item)
        if len(item) < LEAST:
            return None
        for s in starts:
            low, high = max(0, s - errors), min(len(text), s + len(item) + errors)
            if len(item) - (high - low) > errors:
                continue
            distance, end = self.pattern(n, 0, len(item)).best(text[low:high])
            if distance <= errors and (best is None or distance < best[0]):
                tail = text[max(low, low + end - len(item) - distance) : low + end]
                best = distance, low + end - Pattern(item[::-1]).best(tail[::-1])[1], low + end
        return best


def _apart(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit stands beside a passage, where it ends in one itself."""
    before = start > 0 and text[start].isalnum() and text[start - 1].isalnum()
    after = end < len(text) and text[end - 1].isalnum() and text[end].isalnum()
    return not before and not after


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, one after the other."""
    rows = items.select(F.col(key).alias("i"), F.col(text).alias("t")).where("t is not null")
    count = parts(total_chars(rows, "t"), BLOCK_CHARS)
    for block in range(count):
        yield [(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == block).sort("i", "t").toLocalIterator()]


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """(key, item_key, distance, start, end) of every document and the items it holds."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    kinds = f"k {rows.schema['k'].dataType.simpleString()}, i {items.schema[item_key].dataType.simpleString()}, distance int, start int, end int"
    types = rows.select("k").limit(0).toArrow().schema.field("k").type, items.select(item_key).limit(0).toArrow().schema.field(item_key).type
    done = None
    for block in _blocks(items, item_key, item_text):
        part = rows.mapInArrow(_searcher(block, span, types), kinds)
        done = part if done is None else done.unionAll(part)
    return done.withColumnsRenamed({"k": key, "i": item_key})


def _searcher(block: list[tuple[int, str]], span: int, types: tuple[pa.DataType, pa.DataType]):
    schema = pa.schema([("k", types[0]), ("i", types[1]), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        matcher = Matcher(block, span)
        for batch in batches:
            for part in slices(batch):
                found = [(k, *m) for k, t in zip(part.column("k").to_pylist(), part.column("text").to_pylist()) for m in matcher.matches(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], f.type) for j, f in enumerate(schema)], schema=schema)

    return run


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """The rows that hold no item, with all their columns."""
    column = docs.columns.index(text)

    def without(block):
        def run(batches):
            matcher = Matcher(block, span)
            for batch in batches:
                for part in slices(batch, text):
                    yield part.filter(pa.array(np.array([next(matcher.matches(t), None) is None for t in part.column(column).to_pylist()], bool)))

        return run

    for block in _blocks(items, item_key, item_text):
        docs = docs.mapInArrow(without(block), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
