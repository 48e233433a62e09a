"""Registered queries that drain a stream: landed files written from the tables, then the streaming job."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlake.operators import ledgers
from fleetlake.operators.normalize import METRICS
from fleetlake.operators.presentation import present
from fleetlake.plans import inputs
from fleetlake.plans.catalog_fleet import CHANGES, FETCH, TRIGGER_NAME, TRIGGERED, landed_fetches, plain
from fleetlake.plans.catalog_sequence import FLAGS, FOLD, RAW_ITEMS
from fleetlake.plans.catalog_events import KIND, SUMMARY
from fleetlake.plans.oracle import SENT, arr_sql, idx_sql, iso
from fleetlake.plans.registry import query
from fleetlake.session import FRUGAL, settings, shared_folder
from fleetlake.sources import inventory, tables, webhook
from fleetlake.streaming import ingest, tail
from fleetlake.streaming import ledgers as ledger_stream

# The landing arrives in three deliveries, cut by arrival time.
CUTS = ["2024-01-10", "2024-01-20"]
FETCH_CUTS = ["1995-01-01", "1998-01-01"]
MAX_FILES = 1_000_000


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{sf_dir.strip('/').replace('/', '-')}"


def _deliveries(rows: DataFrame, time: str, cuts: list[str] = CUTS) -> list[DataFrame]:
    """The rows of each delivery, by arrival time."""
    at = F.col(time)
    return [
        rows.filter((F.lit(True) if begin is None else at >= F.lit(begin).cast("timestamp")) & (F.lit(True) if end is None else at < F.lit(end).cast("timestamp")))
        for begin, end in zip([None, *cuts], [*cuts, None])
    ]


def _drain(rows: DataFrame, time: str, landing: str, start, cuts: list[str] = CUTS) -> None:
    """Land the rows in deliveries by arrival time and drain the stream after each, restarting from its checkpoint."""
    for part in _deliveries(rows, time, cuts):
        part.write.mode("append").json(landing)
        start().awaitTermination()


def webhook_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete webhook bodies: the wire fields and the extra body fields in one object."""
    raw = inputs.raw_events(spark, sf_dir)
    wire = F.to_json(F.struct(*webhook.WIRE_FIELDS, "public"))
    extra = F.to_json("body_fields")
    body = F.when(F.col("body_fields").isNull(), wire).otherwise(
        F.concat(F.substr(wire, F.lit(1), F.length(wire) - 1), F.lit(","), F.substr(extra, F.lit(2)))
    )
    return raw.select(body.alias("body"), "received_at")


FETCHED = "project_id string, scope_value string, ledger_name string, fetched_at timestamp, trigger_event_id string, http_status int, body string"


@lru_cache(maxsize=8)
def _ingested(application: str, sf_dir: str) -> ingest.Store:
    spark = SparkSession.active()
    landing, fetched = _folder(spark, sf_dir, "landing"), _folder(spark, sf_dir, "fetched")
    store = ingest.Store(_folder(spark, sf_dir, "store"))
    with settings(spark, FRUGAL):
        fetches = landed_fetches(spark, sf_dir)
        for bodies, answers in zip(_deliveries(webhook_bodies(spark, sf_dir), "received_at"), _deliveries(fetches, "fetched_at")):
            bodies.write.mode("append").json(landing, compression="gzip")
            answers.write.mode("append").json(fetched, compression="gzip")
            ingest.start_ingest(
                webhook.stream_landing(spark, landing, max_files=MAX_FILES), store, trigger_names=[TRIGGER_NAME],
                fetches=ledgers.classify_fetches(spark.readStream.schema(FETCHED).json(fetched)), availableNow=True,
            ).awaitTermination()
    return store


def ingested(spark: SparkSession, sf_dir: str) -> ingest.Store:
    """The store after the stream has drained the landing; built once per session."""
    return _ingested(spark.sparkContext.applicationId, sf_dir)


@query("s2_stream_source", sql=arr_sql(f"SELECT archive_key, event_name, device_id, data_type, data, {iso('received_at')} AS received_at FROM arr JOIN sent ON sent_n = n", SENT))
def s2(spark, sf_dir):
    return ingested(spark, sf_dir).archive(spark).select("archive_key", "event_name", "device_id", "data_type", "data", "received_at")


@query("t1_stream_index", sql=idx_sql(f"SELECT event_id, device_id, {iso('event_time')} AS event_time, event_type, battery, connect_time, fw_version, severity FROM idx"))
def t1(spark, sf_dir):
    return ingested(spark, sf_dir).index(spark).select("event_id", "device_id", "event_time", "event_type", "battery", "connect_time", "fw_version", "severity")


@query("t2_stream_state", sql=arr_sql(f"""SELECT project_id, device_id, device_name, {iso('event_time')} AS last_event_time, {iso('last_application_report_at')} AS last_application_report_at, event_type AS last_event_type,
    fw_version, {', '.join(METRICS)}, severity, network_state, serial_category, last_serial_log_line, recent_serial_error_count, {', '.join(FLAGS)}, health_status, array_to_string(types, ',') AS anomaly_types FROM cur""", FOLD))
def t2(spark, sf_dir):
    rows = ingested(spark, sf_dir).states(spark)
    return rows.select(
        "project_id", "device_id", "device_name", "last_event_time", "last_application_report_at", "last_event_type", "fw_version", *METRICS, "severity",
        "network_state", "serial_category", "last_serial_log_line", "recent_serial_error_count", *FLAGS, "health_status",
        F.array_join(F.transform("anomalies", lambda a: a["type"]), ",").alias("anomaly_types"),
    )


@query("t3_stream_history", sql=arr_sql(f"""SELECT device_id, event_type, {iso('event_time')} AS report_time, from_fw AS from_fw_version, to_fw AS to_fw_version, battery_level, NULL::VARCHAR AS error_kind, NULL::BIGINT AS http_status FROM items
  UNION ALL SELECT device_id, 'LEDGER_SYNC_FAILED', {iso('event_time')}, NULL, NULL, NULL, error_kind, http_status FROM trig""", FOLD, RAW_ITEMS, TRIGGERED))
def t3(spark, sf_dir):
    rows = ingested(spark, sf_dir).history(spark)
    return rows.select("device_id", "event_type", "report_time", "from_fw_version", "to_fw_version", "battery_level", "error_kind", F.col("http_status").cast("bigint").alias("http_status"))


TAIL_COLUMNS = ["device_id", "event_time", "event_id", "event_name", "event_type", "source_type", "source_event_type", "plane", "severity", "serial_log_line", "log_line", *METRICS]


@lru_cache(maxsize=8)
def _tailed(application: str, sf_dir: str) -> str:
    spark = SparkSession.active()
    landing, out = _folder(spark, sf_dir, "tail-landing"), _folder(spark, sf_dir, "tail")
    rows = inputs.arrivals(spark, sf_dir).select(*TAIL_COLUMNS, "received_at")

    def start():
        return tail.start_tail(spark.readStream.schema(rows.schema).json(landing).select(*TAIL_COLUMNS), out, availableNow=True)

    _drain(rows, "received_at", landing, start)
    return out


def tailed(spark, sf_dir):
    return tables.read_batches(spark, _tailed(spark.sparkContext.applicationId, sf_dir))


TAIL = f"""cut AS MATERIALIZED (SELECT *, CASE WHEN received_at < TIMESTAMP '{CUTS[0]}' THEN 0 WHEN received_at < TIMESTAMP '{CUTS[1]}' THEN 1 ELSE 2 END AS part FROM arr),
  fresh AS MATERIALIZED (SELECT * FROM cut c WHERE NOT EXISTS (SELECT 1 FROM cut o WHERE o.device_id = c.device_id AND o.part < c.part AND (o.event_time > c.event_time OR (o.event_time = c.event_time AND o.event_id >= c.event_id))))"""


@query("t4_tail_after_cursor", sql=arr_sql(f"SELECT device_id, {iso('event_time')} AS event_time, event_id FROM fresh", TAIL))
def t4(spark, sf_dir):
    return tailed(spark, sf_dir).select("device_id", "event_time", "event_id")


@query("q12_watch", sql=arr_sql(f"SELECT device_id, {iso('event_time')} AS time, {KIND} AS kind, {SUMMARY} AS summary FROM fresh", TAIL))
def q12(spark, sf_dir):
    return present(tailed(spark, sf_dir)).select("device_id", F.col("event_time").alias("time"), "kind", "summary")


@lru_cache(maxsize=8)
def _projected(application: str, sf_dir: str) -> str:
    spark = SparkSession.active()
    landing, out = _folder(spark, sf_dir, "fetch-landing"), _folder(spark, sf_dir, "ledgers")

    def start():
        source = spark.readStream.schema(inventory.FETCH_SCHEMA).json(landing)
        return ledger_stream.start_projection(source, out, f"{out}-checkpoint", availableNow=True)

    _drain(inputs.ledger_fetches(spark, sf_dir), "fetched_at", landing, start, FETCH_CUTS)
    return out


@query("t7_stream_ledgers", sql=plain(f"""SELECT scope_value, ledger_name, {iso('fetched_at')} AS fetched_at, CASE WHEN effect = 'updated' THEN {iso('updated_at')} END AS updated_at FROM stored""", FETCH))
def t7(spark, sf_dir):
    return ledger_stream.stored(spark, _projected(spark.sparkContext.applicationId, sf_dir)).select("scope_value", "ledger_name", "fetched_at", "updated_at")


@lru_cache(maxsize=8)
def _snapshot_tail(application: str, sf_dir: str) -> str:
    spark = SparkSession.active()
    landing, out = _folder(spark, sf_dir, "snapshot-landing"), _folder(spark, sf_dir, "snapshots")
    accepted = ledgers.accept(ledgers.classify_fetches(inputs.ledger_fetches(spark, sf_dir)))
    rows = accepted.filter((F.col("effect") == "updated") & F.col("ledger_name").isin(*ledgers.SNAPSHOT_KINDS)).select("scope_value", "ledger_name", "updated_at", "fetched_at", "seq")

    def start():
        return tail.start_snapshot_tail(spark.readStream.schema(rows.schema).json(landing), out, availableNow=True)

    _drain(rows, "fetched_at", landing, start, FETCH_CUTS)
    return out


@query("t5_stream_snapshot_changes", sql=plain(CHANGES.format(time=iso("updated_at")), FETCH))
def t5_stream(spark, sf_dir):
    return tables.read_batches(spark, _snapshot_tail(spark.sparkContext.applicationId, sf_dir)).drop(tables.BATCH)
