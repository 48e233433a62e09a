"""What the operators share: whole texts in bounded Arrow slices, word hashes and stable row hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.session import checkpoint_dir, prepare

SLICE_BYTES = 1 << 20
CHUNK_CHARS = 6 << 20


def session(spark: SparkSession) -> SparkSession:
    """The session with batches to Python workers bounded to 8 MB (one longer text travels alone)."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/documents.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir`` (a folder of our own on a local master without one)."""
    if checkpoint_dir(df.sparkSession) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint(eager=True)


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null keys are 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(0))


def uniform(*columns: str) -> Column:
    """A number in [0, 1) that depends on the values only, for bounded samples that any rerun repeats."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) / F.lit(float(1 << 31))


def total_chars(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def parts(total_bytes: int, each: int = CHUNK_CHARS) -> int:
    return max(1, math.ceil(total_bytes / each))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices with about ``limit`` bytes of text each; one longer text makes a slice of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    marks = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """64-bit hashes of all words of a text at once: sums of scattered bytes times powers of an odd number, from running totals."""

    BLOCK = 1 << 19

    def __init__(self, lower: bool):
        self.white = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        self.scatter = mixed(fold.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        self.grow(self.BLOCK)

    def grow(self, size: int) -> None:
        base = 0xF1357AEA2E62A9C5
        self.power, self.inverse = (np.cumprod(np.full(size, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends) of the words between ASCII white space."""
        raw = np.frombuffer(text, np.uint8)
        edge = np.diff(np.concatenate([[1], self.white[raw], [1]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            at = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, at + self.BLOCK, side="right")))
            size = int(ends[j - 1]) - at
            if size > len(self.power):
                self.grow(size)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(self.scatter[raw[at : at + size]] * self.power[:size], out=total[1:])
            a, b = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (total[b] - total[a]) * self.inverse[a] + (b - a).astype(np.uint64)
            i = j
        return mixed(out), starts, ends

    def of_texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, number of words of each text) of many texts."""
        filled = [t or b"" for t in texts]
        hashes, starts, _ = self.words(b" ".join(filled))
        begins = np.cumsum([0] + [len(t) + 1 for t in filled])
        return hashes, np.diff(np.searchsorted(starts, begins))


def distinct(x: np.ndarray) -> np.ndarray:
    """Different values, sorted."""
    s = np.sort(x)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def places(x: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Different values, sorted, and where each value stands among them. ``width``: bits that values have at most.

    Values are sorted with their position in the low bits; runs that cut-off low bits leave out of order are sorted once more.
    """
    n = len(x)
    low = max(1, (n - 1).bit_length()) if n else 1
    cut = np.uint64(max(0, width + low - 64))
    packed = np.sort(x.astype(np.uint64) >> cut << np.uint64(low) | np.arange(n, dtype=np.uint64))
    order = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
    v = x[order]
    if (down := v[1:] < v[:-1]).any():
        run = np.cumsum(np.append(0, np.diff(v.astype(np.uint64) >> cut) != 0))
        bad = np.zeros(int(run[-1]) + 1, bool)
        bad[run[1:][down]] = True
        spots = np.flatnonzero(bad[run])
        order[spots] = order[spots][np.argsort(x[order[spots]], kind="stable")]
        v = x[order]
    new = np.append(True, v[1:] != v[:-1])[:n]
    at = np.empty(n, np.int64)
    at[order] = np.cumsum(new) - 1
    return v[new], at


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(size):
        out += words[j : j + n] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
    return mixed(out)
