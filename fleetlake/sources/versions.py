"""Keyed tables in versions: a manifest per batch names the live segments, so readers never list what is no longer live.

A batch adds one segment (a folder of Parquet files). Segments of one size class are merged when there are FAN of them, keeping the newest row per
key, so their number grows with the logarithm of the table only. A reader takes one manifest and sees one version, also while
segments are merged: replaced segments stay for KEPT more batches. A batch that runs again starts from the manifest before it and publishes its own anew.
A batch makes the same few calls to the file system and reads none of the stored rows, whatever the number of batches before it.

There is one writer, as a streaming query is. ``DatedVersions`` keeps one segment per date instead and writes a date anew when a
batch has rows of it, so that reading a day takes that day's files and needs no window.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fleetlake.operators.ordered import newest
from fleetlake.sources.tables import CODEC

BATCH = "batch_id"
FAN = 4
KEPT = 10
SMALL = 4 << 20  # bytes; segments up to this are of the lowest size class
MANIFESTS = "_manifests"
MANY = 10_000  # rows of one key in one batch


@dataclass(frozen=True)
class Segment:
    path: str  # below the table's base folder
    batch: int
    bytes: int
    date: str | None = None


class Files:
    """Calls to the file system of a folder, counted."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.base, self.calls = spark._jvm, base.rstrip("/"), 0
        self.files = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def names(self, folder: str) -> list[str]:
        self.calls += 1
        try:
            return [s.getPath().getName() for s in self.files.listStatus(self.path(folder))]
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return []
            raise

    def read(self, name: str) -> str:
        self.calls += 1
        stream = self.files.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A file that is there whole or not at all."""
        self.calls += 3
        draft = f"{name}.{uuid.uuid4().hex}"
        out = self.files.create(self.path(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.files.delete(self.path(name), False)
        if not self.files.rename(self.path(draft), self.path(name)):
            raise OSError(f"cannot publish {name}")

    def size(self, folder: str) -> int:
        self.calls += 1
        return self.files.getContentSummary(self.path(folder)).getLength()

    def remove(self, name: str) -> None:
        self.calls += 1
        self.files.delete(self.path(name), True)


def size_class(size: int, fan: int = FAN) -> int:
    return 0 if size <= SMALL else 1 + int(math.log(size / SMALL, fan))


def to_merge(sizes: list[int], fan: int = FAN) -> list[int]:
    """Places of the segments to merge now: the lowest full size class and all below it, and what their sum fills in turn."""
    merged: list[int] = []
    while True:
        classes = [size_class(s, fan) for i, s in enumerate(sizes) if i not in merged]
        total = size_class(sum(sizes[i] for i in merged), fan) if merged else None
        full = [c for c in set(classes) if classes.count(c) + (c == total) >= fan]
        if not full:
            return sorted(merged)
        merged = [i for i, s in enumerate(sizes) if size_class(s, fan) <= min(full) or i in merged]


class Versions:
    """A table of the newest row per key. ``column``: the rows lie in this struct column of the segments."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], fan: int = FAN, kept: int = KEPT, column: str | None = None, base: str | None = None):
        self.spark, self.root, self.key, self.fan, self.kept, self.column = spark, root.rstrip("/"), key, fan, kept, column
        self.files = Files(spark, base or root)
        self.inside = self.root[len(self.files.base):].strip("/")  # the table's folder below the base

    def _name(self, name: str) -> str:
        return f"{self.inside}/{name}" if self.inside else name

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(self._name(MANIFESTS)) if n.endswith(".json"))

    def manifest(self, before: int | None = None, versions: list[int] | None = None) -> dict:
        """The newest version, optionally as of the batches before one."""
        found = [v for v in (self.versions() if versions is None else versions) if before is None or v < before]
        if not found:
            return {"segments": [], "retired": [], "schema": None}
        return json.loads(self.files.read(self._name(f"{MANIFESTS}/{found[-1]:010d}.json")))

    def segments(self, before: int | None = None) -> list[Segment]:
        return [Segment(**s) for s in self.manifest(before)["segments"]]

    def _stored(self, segments: list[Segment], schema: str) -> DataFrame:
        reader = self.spark.read.schema(StructType.fromJson(json.loads(schema)))
        return reader.parquet(*[f"{self.files.base}/{s.path}" for s in segments])

    def _newest(self, segments: list[Segment], schema: str) -> DataFrame:
        rows = self._stored(segments, schema)
        rows = rows.select(f"{self.column}.*", BATCH) if self.column else rows
        return rows if len(segments) == 1 else newest(rows, self.key, [F.col(BATCH).desc()])

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest row of every key; None before the first batch."""
        found = self.manifest(before)
        live = [Segment(**s) for s in found["segments"]]
        return self._newest(live, found["schema"]).drop(BATCH) if live else None

    def new_segment(self, batch_id: int) -> str:
        return self._name(f"{batch_id:010d}-{uuid.uuid4().hex[:8]}")

    def commit(self, rows: DataFrame, batch_id: int) -> None:
        """Adds the rows of a batch, one per key."""
        rows = rows.withColumn(BATCH, F.lit(batch_id))
        rows = rows.select(F.struct(*[c for c in rows.columns if c != BATCH]).alias(self.column), BATCH) if self.column else rows
        path = self.new_segment(batch_id)
        rows.write.parquet(f"{self.files.base}/{path}", compression=CODEC)
        self.adopt(path, batch_id, rows.schema.json())

    def adopt(self, path: str, batch_id: int, schema: str) -> None:
        """Adds a segment that is already written."""
        self.publish(batch_id, [Segment(path, batch_id, self.files.size(path))], [], schema)

    def publish(self, batch_id: int, new: list[Segment], replaced: list[str], schema: str) -> None:
        versions = self.versions()
        base = self.manifest(batch_id, versions)
        live = [Segment(**s) for s in base["segments"] if s["path"] not in replaced] + new
        retired = base["retired"] + [[p, batch_id] for p in replaced]
        merge = [live[i] for i in self.due(live)]
        if merge:
            path = self.new_segment(batch_id)
            rows = self._newest(merge, schema)
            (rows.select(F.struct(*[c for c in rows.columns if c != BATCH]).alias(self.column), BATCH) if self.column else rows).write.parquet(f"{self.files.base}/{path}", compression=CODEC)
            live = [s for s in live if s not in merge] + [Segment(path, batch_id, self.files.size(path))]
            retired += [[s.path, batch_id] for s in merge]
        old = [v for v in versions if v < batch_id - self.kept]
        gone = [p for p, at in retired if at < batch_id - self.kept]
        content = {"segments": [asdict(s) for s in live], "retired": [r for r in retired if r[0] not in gone], "schema": schema}
        self.files.write(self._name(f"{MANIFESTS}/{batch_id:010d}.json"), json.dumps(content))
        for p in gone:
            self.files.remove(p)
        for v in old:
            self.files.remove(self._name(f"{MANIFESTS}/{v:010d}.json"))

    def due(self, live: list[Segment]) -> list[int]:
        return to_merge([s.bytes for s in live], self.fan)


class DatedVersions(Versions):
    """One segment per date (column ``event_date``), written anew with what a batch adds."""

    PART = "event_date"
    NONE = "none"

    def read(self, before: int | None = None, dates: list[str] | None = None) -> DataFrame | None:
        """Stored rows; ``dates`` (ISO texts) reads those dates only."""
        found = self.manifest(before)
        live = [Segment(**s) for s in found["segments"] if dates is None or s["date"] in dates]
        return self._stored(live, found["schema"]) if live else None

    def _stored(self, segments: list[Segment], schema: str) -> DataFrame:
        reader = self.spark.read.schema(StructType.fromJson(json.loads(schema)).add("segment", "string").add(self.PART, "string"))
        rows = reader.option("basePath", f"{self.files.base}/{self.inside}".rstrip("/")).parquet(*[f"{self.files.base}/{s.path}" for s in segments])
        return rows.drop("segment")

    def merge(self, rows: DataFrame, batch_id: int, combine: Callable[..., DataFrame], *order: str) -> None:
        """Writes the dates of these rows anew: ``combine`` of what is stored and the rows. A batch has few dates; no other date is read.

        ``order`` holds the key. Rows are dealt once, by date and order, and combined where they lie (``combine`` takes these columns too);
        only if a key came very often, its rows are first combined where they are read, so that none gathers them.
        """
        part = F.coalesce(F.date_format("event_time", "yyyy-MM-dd"), F.lit(self.NONE))
        rows = rows.withColumn(self.PART, part)
        most = dict(rows.groupBy(self.PART, *self.key).count().groupBy(self.PART).agg(F.max("count")).collect())
        dates = sorted(most)
        found = self.manifest(batch_id)
        stored = [Segment(**s) for s in found["segments"] if s["date"] in dates]
        if stored:
            rows = rows.unionByName(self._stored(stored, found["schema"]))
        if not dates:
            return
        if max(most.values()) > MANY:
            rows = combine(rows)
        folder = self._name(f"segment={batch_id:010d}-{uuid.uuid4().hex[:8]}")
        merged = combine(rows.repartitionByRange(self.PART, *order), [self.PART, *order])
        merged.sortWithinPartitions(self.PART, *order).write.partitionBy(self.PART).parquet(f"{self.files.base}/{folder}", compression=CODEC)
        new = [Segment(f"{folder}/{self.PART}={d}", batch_id, 0, d) for d in dates]
        self.publish(batch_id, new, [s.path for s in stored], merged.drop(self.PART).schema.json())

    def due(self, live: list[Segment]) -> list[int]:
        return []
