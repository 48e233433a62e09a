"""Session settings the library relies on."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "fleetlake", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session comes from spark-submit."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.extraJavaOptions", "-Xss4m")  # plans of streaming batches are analysed on threads of their own
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that change results, applied to whatever session the caller has."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Devices differ in size; a batch sent to Python is bounded by bytes, not only by rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
    # Functions sent to Python workers travel by value, so executors need no copy of this package.
    cloudpickle.register_pickle_by_value(sys.modules["fleetlake"])
    return spark


# Shuffle files go when the query that wrote them ends, not when the driver happens to collect garbage; small compressed files are not gathered into long tasks.
FRUGAL = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.files.maxPartitionBytes": "16m"}
# A write to two folders keeps a file open for each and does not sort its rows.
TWO_FOLDERS = {"spark.sql.maxConcurrentOutputFileWriters": "2"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for what is written inside; streams started inside keep them, the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the session names; on a local master without one, a folder of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            return None
        configured = tempfile.mkdtemp(prefix="fleetlake-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def shared_folder(spark: SparkSession) -> str:
    """The same, for work that cannot do without: a loop whose plan would grow, a table that several jobs read."""
    folder = checkpoint_dir(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor does not replay the whole loop and the plan does not grow with its rounds."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
