"""Product inventory payloads and ledger snapshot landing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Device fields of an inventory payload; alternatives of one fact stand next to each other.
INVENTORY_COLUMNS = [
    "id", "device_id", "deviceId", "name", "product_id", "productId", "connected",
    "system_firmware_version", "systemFirmwareVersion", "firmware_version", "firmwareVersion", "last_heard", "lastHeard",
    "platform_id", "platformId", "last_ip_address", "lastIpAddress",
]
TYPES = {"connected": "boolean", "last_heard": "timestamp", "lastHeard": "timestamp"}
DEVICE = "struct<" + ",".join(f"{c}:{TYPES.get(c, 'string')}" for c in INVENTORY_COLUMNS) + ">"
FETCH_SCHEMA = (
    "ledger_name string, product_id string, scope_value string, http_status int, body string, fetched_at timestamp, seq bigint"
)


def explode_pages(pages: DataFrame) -> DataFrame:
    """Inventory page texts (column ``page``): a device list at the root, under ``devices`` or under ``data``."""
    listed = F.from_json("page", f"array<{DEVICE}>")
    wrapped = F.from_json("page", f"struct<devices:array<{DEVICE}>,data:array<{DEVICE}>>")
    at_root = F.trim("page").startswith("[")
    devices = F.when(at_root, listed).otherwise(F.coalesce(wrapped["devices"], wrapped["data"]))
    return pages.select(F.explode(devices).alias("d")).select(*[F.col(f"d.{c}") for c in INVENTORY_COLUMNS])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One page response per file."""
    return explode_pages(spark.read.text(path, wholetext=True).withColumnRenamed("value", "page"))


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    """Landing files of ledger fetches, one JSON line per response."""
    return spark.read.schema(FETCH_SCHEMA).json(path)
