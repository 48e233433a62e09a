"""Stored tables: layout and append without a table format.

Layouts follow the reads: the archive and the index are partitioned by date and sorted by device inside, so a
device and time filter prunes directories and row groups. What a stream passes on is written per batch id; writing
the same batch again replaces it, so a replay after a failure changes nothing. Tables of the newest row per key are in ``versions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH = "batch_id"
CODEC = "zstd"  # of what a stream stores: ids and digests take half of what they take by Spark's own choice


def _write_by_date(df: DataFrame, path: str, mode: str, *order: str) -> None:
    df.sortWithinPartitions("event_date", *order).write.mode(mode).partitionBy("event_date").parquet(path)


def write_archive(records: DataFrame, path: str, mode: str = "append") -> None:
    """No shuffle: landed files hold few dates each, so every task writes few files."""
    _write_by_date(records, path, mode, "device_id", "archive_key")


def write_arrivals(arrivals: DataFrame, path: str, mode: str = "append") -> None:
    """Normalized deliveries in landing order, without a shuffle."""
    _write_by_date(arrivals.withColumn("event_date", F.to_date("event_time")), path, mode, "device_id", "event_time")


def write_event_index(index: DataFrame, path: str, mode: str = "append") -> None:
    """Range partitioning after the de-duplication splits a device that fills a day over several files."""
    dated = index.withColumn("event_date", F.to_date("event_time"))
    _write_by_date(dated.repartitionByRange("event_date", "device_id", "event_time"), path, mode, "device_id", "event_time")


def write_dealt_index(index: DataFrame, path: str, mode: str = "append") -> None:
    """The same layout for an index whose rows were dealt by date, device and time before the de-duplication: nothing moves again."""
    _write_by_date(index.withColumn("event_date", F.to_date("event_time")), path, mode, "device_id", "event_time")


def write_states(states: DataFrame, path: str, mode: str = "append") -> None:
    """One row per device, sorted by project and device inside the files."""
    states.sortWithinPartitions("project_id", "device_id").write.mode(mode).parquet(path)


def write_payloads(payloads: DataFrame, path: str, name: str, buckets: int) -> DataFrame:
    """One row per archive key in sorted buckets of the key, as the table ``name``: a join on the key moves the other side alone."""
    dealt = payloads.repartition(buckets, "archive_key")
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, "archive_key").sortBy("archive_key").saveAsTable(name)
    return payloads.sparkSession.table(name)


def read_event_index(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One directory per batch id, replaced when the batch is replayed."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}", compression=CODEC)


def write_dated_batch(df: DataFrame, path: str, batch_id: int, *order: str) -> None:
    """The same below a date (column ``event_date``): readers prune by date first, a replay replaces its own files."""
    rows = df.withColumn(BATCH, F.lit(batch_id)).sortWithinPartitions("event_date", *order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", BATCH).parquet(path, compression=CODEC)


def read_batches(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).option("basePath", path).parquet(path)
