"""Documents in chunks, and what a chunk tells the rest of the corpus: sorted keys, packed by key range.

Corpus-wide questions of the kind "who else has this key" would move one row per word. Here every chunk of documents (a few MB of text,
chosen by a hash of the row) sorts its own different keys first and sends one binary value per key range ("shelf"): the
differences of neighbouring keys, byte by byte and compressed to little more than their information. A shelf answers with arrays in the order of the keys it was sent, which the chunk can rebuild from its texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import CHUNK_CHARS, parts, total_chars


def pack(values: np.ndarray) -> bytes:
    """Unsigned values as compressed byte planes, without leading planes of zeros."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T[:width]).tobytes())


def unpack(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, count)
    out = np.zeros((count, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.uint64).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, count: int) -> np.ndarray:
    return np.cumsum(unpack(data, count), dtype=np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


@dataclass(frozen=True)
class Layout:
    """How a corpus is cut: ``chunks`` of documents, 2**shelf_bits key ranges, and hash bits that keep chance hits of a filter rare."""

    chunks: int
    shelf_bits: int
    filter_bits: int

    def cuts(self, keys: np.ndarray, width: int = 64) -> list[tuple[int, int, int]]:
        """(shelf, start, end) of the sorted keys, empty shelves left out."""
        shelf = (keys >> np.uint64(width - self.shelf_bits)).astype(np.int64) if self.shelf_bits else np.zeros(len(keys), np.int64)
        starts = np.flatnonzero(np.diff(shelf, prepend=-1))
        return [(int(shelf[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(keys)])]


def layout(docs: DataFrame, text: str, chunk_chars: int = CHUNK_CHARS) -> Layout:
    """Follows the bytes of text alone, so it is the same for every run over the same rows."""
    size = total_chars(docs, text)
    chunks = parts(size, chunk_chars)
    return Layout(chunks, max(3, math.ceil(math.log2(chunks + 1)) - 1), min(60, max(24, size.bit_length() + 6)))


def chunked(docs: DataFrame, plan: Layout, key: str, text: str) -> DataFrame:
    """(chunk, k, text): the same expression in every use, so that one shuffle of the texts serves all of them."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("text"))
    return rows.select(F.pmod(F.xxhash64("k", "text"), F.lit(plan.chunks)).cast("int").alias("chunk"), "k", "text")


def rows(schema: pa.Schema, columns: dict[str, list]) -> pa.Table:
    return pa.Table.from_pydict(columns, schema)
