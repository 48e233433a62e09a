"""Raw webhook bodies as batch or stream, with rejected bodies kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlake.functions.payload import json_object

# The wire fields of a webhook body; everything else stays reachable through ``body_fields``.
WIRE_FIELDS = [
    "event", "coreid", "deviceId", "product_id", "productId", "published_at", "timestamp", "fw_version", "sourceType",
    "collectorId", "transport", "eventType", "deviceName", "logLine", "projectId", "data",
]
RAW_COLUMNS = [*WIRE_FIELDS, "public", "data_is_text", "body_fields", "received_at"]
LANDING_SCHEMA = "body string, received_at timestamp"


def parse_bodies(landed: DataFrame) -> DataFrame:
    """Body text to raw event columns plus ``status``: accepted, missing or invalid.

    An empty body counts as an empty object, a null one is missing, anything but one JSON object is invalid.
    """
    text = F.when(F.trim("body") == "", "{}").otherwise(F.col("body"))
    opened = landed.withColumn("body_fields", json_object(text)).withColumn("_v", F.try_parse_json(text))
    status = F.when(F.col("body").isNull(), "missing").when(F.col("body_fields").isNull(), "invalid").otherwise("accepted")
    data_type = F.schema_of_variant(F.try_variant_get("_v", "$.data", "variant"))
    return opened.withColumns({
        "status": status,
        **{f: F.try_element_at("body_fields", F.lit(f)) for f in WIRE_FIELDS},
        "public": F.try_element_at("body_fields", F.lit("public")).try_cast("boolean"),
        "data_is_text": F.coalesce(data_type == "STRING", F.lit(True)),
    }).drop("_v")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("status") == "accepted").select(*RAW_COLUMNS)


def quarantined(parsed: DataFrame) -> DataFrame:
    """Rejected bodies as received, with the reason."""
    return parsed.filter(F.col("status") != "accepted").select("body", "received_at", "status")


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Landing files: one JSON line per delivery with the body text and its arrival time."""
    return spark.read.schema(LANDING_SCHEMA).json(path)


def stream_landing(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(LANDING_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def stream_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same landing columns from a Kafka topic (needs the Kafka connector on the class path)."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return source.select(F.col("value").cast("string").alias("body"), F.col("timestamp").alias("received_at"))
