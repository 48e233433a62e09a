"""The driver tables rendered as the shapes the engine works on (raw events, inventory, ledgers)."""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlake.functions.values import iso
from fleetlake.operators import state
from fleetlake.operators.archive import archive_records, payloads as payloads_of
from fleetlake.operators.normalize import INDEX_ORDER, event_index, normalize
from fleetlake.operators.ordered import Slices, plan_slices
from fleetlake.session import shared_folder
from fleetlake.sources.tables import read_event_index, write_arrivals, write_dealt_index, write_payloads, write_states

AS_OF = "2024-01-31 00:00:00"
POSIX_EASTERN = "EST5EDT,M3.2.0/2:00:00,M11.1.0/2:00:00"


ROWS_PER_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """Ranges of about ``ROWS_PER_TASK`` rows of a stored table, however its files are split: tasks grow in number, not in time and memory."""
    return rows.repartitionByRange(max(1, math.ceil(rows.count() / ROWS_PER_TASK)), *order)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook bodies: JSON payloads plain, entity-encoded, without opening brace or truncated; serial lines."""
    e = dealt(table(spark, sf_dir, "events"), "ts", "event_id").withColumns({
        "n": F.col("event_id"),
        "ks": F.regexp_extract("props", "([0-9]+)", 1),
        "et": F.col("event_type"),
        "t0": F.date_trunc("millisecond", F.col("ts").cast("timestamp")),
    }).withColumns({
        "k": F.col("ks").cast("bigint"),
        "received_at": F.timestamp_micros(F.unix_micros("t0") + (F.col("n") * 37 % 9000) * 1000),
    })
    n, k, et = F.col("n"), F.col("k"), F.col("et")
    view, click, serial = et == "view", et == "click", et.isin("purchase", "signup")
    text_time = iso(F.col("t0"))
    value = F.col("value").cast("string")
    day = F.dayofmonth("t0")
    fw = F.when(day <= 10, "v1").when(day <= 20, "v2").otherwise("v3")

    members = F.concat_ws(
        ",",
        F.concat(F.lit('"'), F.when(n % 6 == 0, "Battery").otherwise("battery"), F.lit('":'), F.col("ks")),
        F.concat(F.lit('"connecttime":'), value),
        F.concat(F.lit('"resets":'), F.floor(n / 1000).cast("bigint").cast("string")),
        F.concat(F.lit('"alerts":'), F.when(k % 10 == 0, "1").otherwise("0")),
        F.when(n % 10 != 9, F.concat(F.lit('"occupancy":'), (k % 7).cast("string"), F.lit(',"dailyoccupancy":"'), (k * 2).cast("string"), F.lit('"'))),
        F.concat(F.lit('"'), F.when(n % 5 == 0, "temperature").otherwise("temp"), F.lit('":'), (20 + k / 4).cast("string")),
        F.when(n % 2 == 0, F.concat(F.lit('"fw_version":"'), fw, F.lit('"'))),
    )
    plain = F.concat(F.lit("{"), members, F.lit("}"))
    encoded = F.replace(plain, F.lit('"'), F.lit("&quot;"))
    reading = (
        F.when(n % 4 == 0, plain).when(n % 4 == 1, encoded)
        .when(n % 4 == 2, F.substr(encoded, F.lit(2))).otherwise(F.concat(F.lit("{"), members))
    )
    status = F.concat(F.lit('{"cloudRecoverStage":'), (k % 5).cast("string"), F.lit(',"networkState":"up","queueDepth":'), F.col("ks"), F.lit("}"))

    phrases = ["modem ncp error -210", "cloud disconnected", "battery charge ok", "watchdog fed",
               "publishqueue depth 7", "reboot requested", "reconnect retry 3", "idle"]
    levels = ["[TRACE] ", "[INFO] ", "[WARN] ", "[ERROR] ", "[] "]
    line = F.concat(
        F.element_at(F.array(*map(F.lit, levels)), (n % 5 + 1).cast("int")),
        F.element_at(F.array(*map(F.lit, phrases)), (k % 8 + 1).cast("int")),
    )
    lifecycle = F.element_at(
        F.array(F.lit("SERIAL_CONNECTED"), F.lit("SERIAL_DISCONNECTED"), F.lit("SERIAL_MISSING")), (n % 3 + 1).cast("int")
    )
    device = F.col("user_id").cast("string")
    return e.select(
        F.when(view, "sensor-hook").when(click, "device-status").when(et == "error", "watchdog-v2").otherwise("serialLog").alias("event"),
        F.when(n % 11 != 0, device).alias("coreid"),
        F.when(n % 13 != 0, device).alias("deviceId"),
        F.when(n % 3 == 0, F.concat(F.lit("prod"), (F.col("user_id") % 4).cast("string"))).alias("product_id"),
        F.lit(None).cast("string").alias("productId"),
        F.when(n % 13 != 0, text_time).alias("published_at"),
        F.when(n % 7 != 0, text_time).alias("timestamp"),
        F.lit(False).alias("public"),
        F.when(view & (n % 2 == 1), fw).alias("fw_version"),
        F.when(serial, "serial-forwarder").alias("sourceType"),
        F.when(serial, F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string"))).alias("collectorId"),
        F.when(serial, "usb").alias("transport"),
        F.when(et == "purchase", "LOG").when(et == "signup", lifecycle).alias("eventType"),
        F.when(n % 4 == 1, F.concat(F.lit("dev-"), device)).alias("deviceName"),
        F.when((et == "purchase") & (n % 7 != 0), line).alias("logLine"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))).alias("projectId"),
        F.when(view, reading).when(click, status).when(et == "error", "wdt fired")
        .when((et == "purchase") & (n % 7 == 0), line).alias("data"),
        F.lit(True).alias("data_is_text"),
        F.when(click, F.create_map(F.lit("connecttime"), value)).alias("body_fields"),
        "received_at",
        n.alias("seq"),
    )


def arrivals_from_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery, normalized from the raw bodies."""
    return normalize(raw_events(spark, sf_dir))


def index_from_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The de-duplicated event index of the stored arrivals: bodies are parsed once."""
    rows = arrivals(spark, sf_dir).withColumn("event_date", F.to_date("event_time"))
    return event_index(dealt(rows, *INDEX_ORDER), INDEX_ORDER).drop("event_date")


def states_from_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over all arrivals, done once; ingestion keeps this table up to date batch by batch."""
    return state.current_state(arrivals(spark, sf_dir), slices(spark, sf_dir, state.KEY, "received_at"))


@lru_cache(maxsize=64)
def _stored(application: str, sf_dir: str, name: str) -> str:
    """Write a table once per session into the shared folder, the way ingestion keeps it."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark).rstrip('/')}/{application}/{name}-{sf_dir.strip('/').replace('/', '-')}"
    build, write = TABLES[name]
    write(build(spark, sf_dir).drop("payload"), path, mode="overwrite")
    return path


TABLES = {"arrivals": (arrivals_from_raw, write_arrivals), "index": (index_from_arrivals, write_dealt_index), "states": (states_from_arrivals, write_states)}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_event_index(spark, _stored(spark.sparkContext.applicationId, sf_dir, name))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored normalized deliveries."""
    return _table(spark, sf_dir, "arrivals")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored event index; device queries read this table, not the raw bodies."""
    return _table(spark, sf_dir, "index")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored current state, one row per device; fleet questions read this table and never fold arrivals."""
    return _table(spark, sf_dir, "states")


def reported_archive(spark, sf_dir):
    """Archive objects with watchdog details; one in sixteen objects is missing.

    The event's id and name give the details, row by row: a key that was delivered many times has as many rows here as deliveries.
    """
    number = F.conv(F.substring("event_id", 1, 1), 16, 10).cast("int")
    rows = arrivals(spark, sf_dir).withColumn("n", number).filter(F.col("n") != 0)
    n, wd = F.col("n"), F.col("event_name") == "watchdog-v2"
    return archive_records(rows, {
        "reset_cause": F.when(wd & (n % 2 == 0), F.concat(F.lit("cause-"), n.cast("string"))),
        "details": F.when(wd & (n % 3 == 0), "stack"),
        "message": F.when(wd, "timer expired"),
    })


@lru_cache(maxsize=64)
def _payloads(application: str, sf_dir: str) -> str:
    spark, place = SparkSession.active(), sf_dir.strip("/").replace("/", "-")
    name = f"payloads_{zlib.crc32(f'{application}/{place}'.encode()):08x}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_payloads(payloads_of(reported_archive(spark, sf_dir)), f"{shared_folder(spark).rstrip('/')}/{application}/{name}-{place}", name, buckets)
    return name


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archive's payloads say, one row per archive key, stored in buckets of the key."""
    return spark.table(_payloads(spark.sparkContext.applicationId, sf_dir))


@lru_cache(maxsize=64)
def _slices(application: str, sf_dir: str, source: str, key: tuple[str, ...], time: str, rows: int | None, bucket: int) -> Slices | None:
    spark = SparkSession.active()
    table_of = {"arrivals": arrivals, "fetches": ledger_fetches}[source]
    extra = {} if rows is None else {"rows_per_slice": rows}
    return plan_slices(table_of(spark, sf_dir).select(*key, time), list(key), time, bucket_seconds=bucket, **extra)


def slices(spark: SparkSession, sf_dir: str, key: list[str], time: str, bucket_seconds: int = 60, source: str = "arrivals") -> Slices | None:
    """Slicing of the large devices, measured once per session and input, like table statistics."""
    rows = spark.conf.get("fleetlake.rows.per.slice", None)
    return _slices(spark.sparkContext.applicationId, sf_dir, source, tuple(key), time, int(rows) if rows else None, bucket_seconds)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor inventory rows as they arrive (ids and names under alternative fields)."""
    c = dealt(table(spark, sf_dir, "customer"), "c_custkey")
    key = F.col("c_custkey")
    text = key.cast("string")
    return c.select(
        F.when(key % 3 == 0, text).alias("id"),
        F.when(key % 3 == 1, text).alias("device_id"),
        F.when(key % 3 != 0, text).alias("deviceId"),
        F.when(key % 9 != 8, F.col("c_name")).alias("name"),
        F.when(key % 2 == 0, F.lit("9")).alias("product_id"),
        F.lit(None).cast("string").alias("productId"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("connected"),
        F.when(key % 7 != 0, F.col("c_mktsegment")).alias("system_firmware_version"),
        F.when(key % 4 != 0, F.timestamp_seconds(F.lit(1706659200) - (key % 200) * 600)).alias("last_heard"),
    )


def ledger_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing table of snapshot fetches: status and body, one row per order."""
    o = dealt(table(spark, sf_dir, "orders"), "o_orderkey")
    key = F.col("o_orderkey")
    updated = iso(F.col("o_orderdate").cast("timestamp"))
    soc = F.pmod(F.floor("o_totalprice").cast("bigint"), F.lit(120)).cast("string")
    resets = F.when(key % 4 == 0, F.concat(F.lit('"'), (key % 9).cast("string"), F.lit('"'))).otherwise((key % 9).cast("string"))
    data = F.concat(
        F.lit('{"schemaVersion":'), F.when(key % 3 == 0, '"2"').when(key % 3 == 1, "2").otherwise("1"),
        F.lit(',"battery":{"soc":'), soc, F.lit('},"firmware":{"version":"fw-'), (key % 4).cast("string"), F.lit('","resetCount":'), resets,
        F.lit('},"connection":{"state":"'), F.when(key % 2 == 0, "connected").otherwise("disconnected"), F.lit('"}'),
        F.when(key % 5 == 0, F.concat(F.lit(',"startup":{"resetCount":'), (key % 6).cast("string"), F.lit("}"))).otherwise(""),
        F.lit("}"),
    )
    ok = F.concat(F.lit('{"instance":{"data":'), data, F.when(key % 23 != 0, F.concat(F.lit(',"updated_at":"'), updated, F.lit('"'))).otherwise(""), F.lit(',"size_bytes":'), F.length(data).cast("string"), F.lit("}}"))
    status = F.col("o_orderstatus")
    code = (
        F.when(status == "P", F.when(key % 41 == 0, F.lit(None)).otherwise(200))
        .when(status == "O", F.when(key % 10 == 3, 401).otherwise(404))
        .otherwise(F.when(key % 10 == 3, 418).otherwise(503)).cast("int")
    )
    return o.select(
        F.when(key % 3 == 0, "device-settings").when(key % 6 == 5, "device-data").otherwise("device-status").alias("ledger_name"),
        F.lit("9").alias("product_id"),
        F.col("o_custkey").cast("string").alias("scope_value"),
        code.alias("http_status"),
        F.when(code == 200, F.when(key % 29 == 0, F.substr(ok, F.lit(1), F.lit(20))).when(key % 31 == 0, "{}").otherwise(ok)).alias("body"),
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (key % 86400) * 1_000_000).alias("fetched_at"),
        key.alias("seq"),
    )


def configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration JSON per device: defaults by nation, overrides for some devices."""
    c = dealt(table(spark, sf_dir, "customer"), "c_custkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    key, nk = F.col("c_custkey"), F.col("n_nationkey")
    zone = F.when(nk % 4 == 0, "America/New_York").when(nk % 4 == 1, "UTC").when(nk % 4 == 2, "Asia/Kolkata").otherwise(POSIX_EASTERN)
    defaults = F.concat(
        F.lit('{"timing":{"reportingIntervalSec":'), F.when(nk % 2 == 0, "3600").otherwise("7200"),
        F.lit(',"connectAttemptBudgetSec":600,"openHour":6,"closeHour":22,"timezone":"'), zone, F.lit('"}}'),
    )
    overrides = (
        F.when(key % 10 == 0, '{"timing":{"reportingIntervalSec":null},"reporting":{"intervalMinutes":30}}')
        .when(key % 10 == 5, '{"timing":{"reportingIntervalSec":"900","openHour":20,"closeHour":4}}')
        .when(key % 10 == 3, '{"timing":{"timezone":"Mars/Olympus"}}')
    )
    return c.join(F.broadcast(nation), c.c_nationkey == nk).select(
        key.cast("string").alias("device_id"), defaults.alias("product_defaults"), overrides.alias("device_settings")
    )
