"""Registered queries: sources, sinks, normalization, filters, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake.functions.payload import analytics_payload, field_exact, field_ignoring_case, ingest_payload, lower_keys
from fleetlake.operators import archive, correlate, filters, normalize, presentation
from fleetlake.operators.ordered import newest
from fleetlake.plans import inputs
from fleetlake.plans.oracle import SENT, arr_sql, idx_sql, iso
from fleetlake.plans.registry import query
from fleetlake.sources import webhook

# ---- sources and sinks


def landed_bodies(spark, sf_dir):
    """Bodies as text: mostly complete, some truncated, empty or missing."""
    raw = inputs.raw_events(spark, sf_dir)
    body = F.to_json(F.struct(*webhook.WIRE_FIELDS, "public"))
    n = F.col("seq")
    text = F.when(n % 29 == 0, F.substr(body, F.lit(1), F.length(body) - 1)).when(n % 31 == 0, "").when(n % 37 != 0, body)
    return raw.select(text.alias("body"), "received_at", "seq")


@query("s1_raw_source", sql=arr_sql(f"""SELECT
  CASE WHEN n % 29 = 0 THEN 'invalid' WHEN n % 31 = 0 THEN 'accepted' WHEN n % 37 = 0 THEN 'missing' ELSE 'accepted' END AS status,
  CASE WHEN n % 29 = 0 OR n % 31 = 0 OR n % 37 = 0 THEN NULL ELSE event_name END AS event,
  CASE WHEN n % 29 = 0 OR n % 31 = 0 OR n % 37 = 0 THEN NULL ELSE source_event_type END AS source_event_type,
  n AS seq FROM arr"""))
def s1(spark, sf_dir):
    parsed = webhook.parse_bodies(landed_bodies(spark, sf_dir))
    return parsed.select("status", "event", F.col("eventType").alias("source_event_type"), "seq")


@query("s1_quarantine", sql=arr_sql(f"""SELECT CASE WHEN n % 29 = 0 THEN 'invalid' ELSE 'missing' END AS status, {iso('received_at')} AS received_at
  FROM arr WHERE n % 29 = 0 OR (n % 31 <> 0 AND n % 37 = 0)"""))
def s1_quarantine(spark, sf_dir):
    return webhook.quarantined(webhook.parse_bodies(landed_bodies(spark, sf_dir))).select("status", "received_at")


@query("s3_raw_archive", sql=arr_sql(f"""SELECT archive_key, substr(event_time_text, 1, 10) AS event_date, device_id, event_name,
  event_time_text AS published_at, data, data_type, legacy_fw_version AS fw_version, {iso('received_at')} AS received_at FROM arr JOIN sent ON sent_n = n""", SENT))
def s3(spark, sf_dir):
    return archive.archive_records(inputs.arrivals_from_raw(spark, sf_dir)).drop("body_fields")


def redelivered(spark, sf_dir):
    """Arrivals of which every fifth is delivered again ten minutes later."""
    rows = inputs.arrivals_from_raw(spark, sf_dir).drop("payload", "body_fields")
    again = rows.filter(F.substring("event_id", 1, 1) < "4").withColumns({
        "received_at": F.timestamp_micros(F.unix_micros("received_at") + 600_000_000), "fw_version": F.lit("again"),
    })
    return rows.unionByName(again)


@query("s4_event_index", sql=arr_sql(f"""SELECT device_id, {iso('event_time')} AS event_time, event_name, event_type, plane, source_type, battery,
    CASE WHEN substr(event_id, 1, 1) < '4' THEN 'again' ELSE fw_version END AS fw_version,
    {iso("CASE WHEN substr(event_id, 1, 1) < '4' THEN received_at + INTERVAL 10 MINUTE ELSE received_at END")} AS received_at
  FROM idx""", """idx AS (SELECT * FROM arr QUALIFY row_number() OVER (PARTITION BY device_id, event_time_text
    ORDER BY CASE WHEN substr(event_id, 1, 1) < '4' THEN received_at + INTERVAL 10 MINUTE ELSE received_at END DESC, event_id DESC) = 1)"""))
def s4(spark, sf_dir):
    return normalize.event_index(redelivered(spark, sf_dir)).select(
        "device_id", "event_time", "event_name", "event_type", "plane", "source_type", "battery", "fw_version", "received_at"
    )


def oddly_timed(spark, sf_dir):
    """Raw events of which some have times that cannot be read, and some name their instant with an offset."""
    n = F.col("seq")
    text = (
        F.when(n % 17 == 0, F.concat(F.lit("no time "), (n % 3).cast("string")))
        .when(n % 19 == 0, F.concat(F.substring("timestamp", 1, 23), F.lit("+00:00"))).otherwise(F.col("timestamp"))
    )
    return inputs.raw_events(spark, sf_dir).withColumns({"timestamp": text, "published_at": F.when(~((n % 17 == 0) | (n % 19 == 0)), F.col("published_at"))})


@query("s4_index_by_time_text", sql=f"""WITH odd AS (SELECT event_id AS n, user_id, date_trunc('milliseconds', ts) AS t0,
    date_trunc('milliseconds', ts) + to_milliseconds(event_id * 37 % 9000) AS received_at FROM events),
  sent AS (SELECT *, CASE WHEN n % 11 <> 0 OR n % 13 <> 0 THEN CAST(user_id AS VARCHAR) ELSE 'unknown' END AS device_id,
    CASE WHEN n % 17 = 0 THEN 'no time ' || (n % 3)
      WHEN n % 19 = 0 AND n % 7 <> 0 THEN strftime(t0, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00'
      WHEN n % 19 = 0 OR (n % 7 = 0 AND n % 13 = 0) THEN {iso('received_at')} ELSE {iso('t0')} END AS event_time_text FROM odd),
  kept AS (SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY device_id, event_time_text ORDER BY received_at DESC) = 1)
  SELECT device_id, event_time_text, CASE WHEN n % 17 = 0 THEN NULL WHEN n % 19 = 0 AND n % 7 = 0 OR (n % 19 <> 0 AND n % 7 = 0 AND n % 13 = 0) THEN {iso('received_at')} ELSE {iso('t0')} END AS event_time,
    {iso('received_at')} AS received_at FROM kept""")
def s4_by_text(spark, sf_dir):
    rows = normalize.event_index(normalize.normalize(oddly_timed(spark, sf_dir)))
    return rows.select("device_id", "event_time_text", "event_time", "received_at")


# ---- normalization projections

def _events(*columns):
    def build(spark, sf_dir):
        return inputs.arrivals_from_raw(spark, sf_dir).select("event_id", *columns)

    return build


def _register(name: str, columns: list[str], spark_columns: list | None = None) -> None:
    body = ", ".join(f"{iso(c)} AS {c}" if c in ("event_time", "received_at") else c for c in columns)
    query(name, sql=arr_sql(f"SELECT event_id, {body} FROM arr"))(_events(*(spark_columns or columns)))


_register("p01_identity", ["device_id", "event_name", "event_time", "event_time_text", "project_id", "is_synthetic_time"])
_register("p05_metrics", ["battery", "connect_time", "reset_count", "alert_count", "occupancy", "daily_occupancy", "temperature"])
_register("p07_firmware", ["fw_version"])
_register("p08_plane", ["plane"])
_register("p09_event_type", ["event_type"])
_register("p10_serial_line", ["serial_log_line"])
_register("p11_severity", ["severity"])
_register("p12_serial_category", ["serial_category"])
_register("p13_event_id", ["device_id", "event_time_text"])
_register("p14_archive_key", ["archive_key"])
_register("p15_network_state", ["network_state"])
_register("p16_flags", ["reconnect_detected", "watchdog_detected", "reset_detected"])
_register("p17_queue_depth", ["queue_depth"])
_register("p18_index_record", [
    "device_id", "event_time", "received_at", "event_name", "archive_key", "data_type", "source_type", "collector_id", "event_type",
    "source_event_type", "device_name", "log_line", "project_id", "plane", "fw_version", "legacy_fw_version", "is_synthetic_time",
])


# Every field of a payload that can be read, in document order.
FIELDS = """CASE WHEN readable THEN concat_ws(',', CASE WHEN n % 6 = 0 THEN 'Battery=' ELSE 'battery=' END || ks, 'connecttime=' || CAST(value AS VARCHAR), 'resets=' || (n // 1000),
    'alerts=' || CASE WHEN k % 10 = 0 THEN '1' ELSE '0' END, CASE WHEN n % 10 <> 9 THEN 'occupancy=' || (k % 7) || ',dailyoccupancy=' || (k * 2) END,
    CASE WHEN n % 5 = 0 THEN 'temperature=' ELSE 'temp=' END || CAST(CAST(20 + k / 4.0 AS DOUBLE) AS VARCHAR), CASE WHEN n % 2 = 0 THEN 'fw_version=' || fw END)
  WHEN et = 'click' THEN 'cloudRecoverStage=' || (k % 5) || ',networkState=up,queueDepth=' || ks END AS fields"""


def field_text(payload):
    return F.array_join(F.transform(F.map_entries(payload), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query("p02_ingest_payload", sql=arr_sql(f"SELECT event_id, {FIELDS} FROM arr"))
def p02(spark, sf_dir):
    rows = inputs.arrivals_from_raw(spark, sf_dir)
    return rows.select("event_id", ingest_payload(F.col("data"), F.lit(True)).alias("payload")).select("event_id", field_text(F.col("payload")).alias("fields"))


@query("p03_analytics_payload", sql=arr_sql(f"SELECT event_id, {FIELDS} FROM arr"))
def p03(spark, sf_dir):
    rows = inputs.arrivals_from_raw(spark, sf_dir)
    return rows.select("event_id", analytics_payload(F.col("data")).alias("payload")).select("event_id", field_text(F.col("payload")).alias("fields"))


@query("p04_field_lookup", sql=arr_sql("""SELECT event_id, CASE WHEN readable THEN ks END AS battery,
  CASE WHEN readable OR et = 'click' THEN CAST(value AS VARCHAR) END AS connecttime FROM arr"""))
def p04(spark, sf_dir):
    rows = inputs.arrivals_from_raw(spark, sf_dir).withColumns({
        "keys": lower_keys(F.col("payload")), "body_keys": lower_keys(F.col("body_fields")),
    })
    maps = [F.col(c) for c in ("payload", "keys", "body_fields", "body_keys")]
    return rows.select("event_id", *[field_ignoring_case(*maps, f).alias(f) for f in ("battery", "connecttime")])


@query("p06_analytics_metrics", sql=arr_sql("""SELECT event_id, CASE WHEN n % 6 <> 0 THEN battery END AS battery, connect_time, reset_count, alert_count,
  occupancy, daily_occupancy, temperature FROM arr"""))
def p06(spark, sf_dir):
    content, metrics = archive.payload_columns(F.col("data"), F.col("body_fields"))
    rows = inputs.arrivals_from_raw(spark, sf_dir).withColumn("content", content)
    return rows.select("event_id", *[c.alias(m) for m, c in metrics.items()])


@query("p06_exact_lookup", sql=arr_sql("SELECT event_id, CASE WHEN readable AND n % 6 <> 0 THEN ks END AS battery FROM arr"))
def p06_exact(spark, sf_dir):
    rows = inputs.arrivals_from_raw(spark, sf_dir)
    return rows.select("event_id", field_exact(analytics_payload(F.col("data")), F.col("body_fields"), "battery").alias("battery"))


CORRELATION_CLASS = """CASE et WHEN 'error' THEN 'watchdog' WHEN 'click' THEN 'status' WHEN 'signup' THEN 'serial-lifecycle'
  WHEN 'purchase' THEN 'serial-log' ELSE 'telemetry' END"""
LOG_CATEGORY = "(['modem','network','power',CASE WHEN n % 5 = 3 THEN 'error' ELSE 'other' END,CASE WHEN n % 5 = 3 THEN 'error' ELSE 'other' END,CASE WHEN n % 5 = 3 THEN 'error' ELSE 'other' END,'reconnect',CASE WHEN n % 5 = 3 THEN 'error' ELSE 'other' END])[k % 8 + 1]"


@query("p20_correlation_class", sql=arr_sql(f"SELECT event_id, {CORRELATION_CLASS} AS class FROM arr"))
def p20(spark, sf_dir):
    rows = inputs.arrivals(spark, sf_dir)
    return rows.select("event_id", correlate.correlation_class(rows).alias("class"))


@query("p21_log_category", sql=arr_sql(f"SELECT event_id, CASE WHEN n % 7 = 0 THEN 'other' ELSE {LOG_CATEGORY} END AS category FROM arr WHERE et = 'purchase'"))
def p21(spark, sf_dir):
    rows = inputs.arrivals(spark, sf_dir).filter(F.col("event_type") == "serial.log")
    return rows.select("event_id", correlate.log_category(F.col("log_line")).alias("category"))


ARCHIVE_SQL = """hex AS MATERIALIZED (SELECT *, strpos('0123456789abcdef', substr(event_id, 1, 1)) - 1 AS h FROM idx)"""


@query("p22_details", sql=idx_sql(f"""SELECT event_id, {CORRELATION_CLASS} AS class,
  CASE WHEN et = 'error' AND h <> 0 AND h % 2 = 0 THEN 'cause-' || h END AS reset_cause,
  CASE WHEN et = 'error' AND h <> 0 THEN CASE WHEN h % 3 = 0 THEN 'stack' ELSE 'timer expired' END END AS watchdog_detail,
  CASE WHEN et = 'click' AND h <> 0 THEN CAST(k % 5 AS DOUBLE) END AS cloud_recover_stage,
  CASE WHEN et = 'click' AND h <> 0 THEN 'up' END AS status_network_state,
  CASE WHEN et = 'click' AND h <> 0 THEN CAST(k AS DOUBLE) END AS status_queue_depth,
  CASE WHEN et = 'signup' THEN source_event_type END AS lifecycle FROM hex""", ARCHIVE_SQL))
def p22(spark, sf_dir):
    joined = archive.with_payload(inputs.index(spark, sf_dir), inputs.payloads(spark, sf_dir))
    rows = correlate.details(archive.payload_metrics(joined))
    return rows.select(
        "event_id", "class", "reset_cause", F.when(F.col("class") == "watchdog", F.col("detail")).alias("watchdog_detail"),
        "cloud_recover_stage", "status_network_state", "status_queue_depth", "lifecycle",
    )


@query("j1_payload_join", sql=idx_sql("SELECT event_id, h <> 0 AS has_payload, CASE WHEN h <> 0 THEN legacy_fw_version END AS archived_fw_version FROM hex", ARCHIVE_SQL))
def j1(spark, sf_dir):
    joined = archive.with_payload(inputs.index(spark, sf_dir), inputs.payloads(spark, sf_dir))
    return joined.select("event_id", "has_payload", "archived_fw_version")


@query("j1_redelivered", sql=idx_sql("""SELECT event_id, true AS has_payload,
    CASE WHEN substr(event_id, 1, 1) < '4' THEN 'again' ELSE legacy_fw_version END AS archived_fw_version FROM idx""", ))
def j1_redelivered(spark, sf_dir):
    """Objects delivered again replace the first delivery; every event meets one object."""
    first = archive.archive_records(inputs.arrivals(spark, sf_dir))
    again = archive.archive_records(inputs.arrivals(spark, sf_dir).filter(F.substring("event_id", 1, 1) < "4")).withColumns({
        "received_at": F.timestamp_micros(F.unix_micros("received_at") + 600_000_000), "fw_version": F.lit("again"),
    })
    joined = archive.with_payload(inputs.index(spark, sf_dir), first.unionByName(again))
    return joined.select("event_id", "has_payload", "archived_fw_version")


TELEMETRY_TEXT = """concat_ws(' ', 'occupancy=' || CAST(occupancy AS BIGINT), 'dailyOccupancy=' || CAST(daily_occupancy AS BIGINT), 'battery=' || CAST(battery AS BIGINT),
  'temperature=' || CASE WHEN temperature = floor(temperature) THEN CAST(CAST(temperature AS BIGINT) AS VARCHAR) ELSE CAST(temperature AS VARCHAR) END,
  'connectTime=' || CASE WHEN connect_time = floor(connect_time) THEN CAST(CAST(connect_time AS BIGINT) AS VARCHAR) ELSE CAST(connect_time AS VARCHAR) END,
  'resetCount=' || CAST(reset_count AS BIGINT), 'alertCount=' || CAST(alert_count AS BIGINT))"""
KIND = "CASE et WHEN 'error' THEN 'WATCHDOG' WHEN 'purchase' THEN 'SERIAL' WHEN 'signup' THEN 'COLLECTOR' ELSE 'TELEMETRY' END"


@query("p23_kind", sql=idx_sql(f"SELECT event_id, {KIND} AS kind FROM idx"))
def p23(spark, sf_dir):
    return presentation.present(inputs.index(spark, sf_dir).drop("data")).select("event_id", "kind")


SUMMARY = f"""CASE et WHEN 'error' THEN 'Fault Watchdog' WHEN 'purchase' THEN line
    WHEN 'signup' THEN (['Serial device connected','Serial device disconnected','Serial device missing'])[n % 3 + 1]
    ELSE CASE WHEN {TELEMETRY_TEXT} <> '' THEN {TELEMETRY_TEXT} ELSE 'Telemetry Event' END END"""


@query("p24_summary", sql=idx_sql(f"SELECT event_id, {SUMMARY} AS summary FROM idx"))
def p24(spark, sf_dir):
    return presentation.present(inputs.index(spark, sf_dir).drop("data")).select("event_id", "summary")


@query("p25_severity", sql=idx_sql("""SELECT event_id, CASE severity WHEN 'TRACE' THEN 'debug' WHEN 'INFO' THEN 'info' WHEN 'WARN' THEN 'warning' WHEN 'ERROR' THEN 'error' END AS display_severity FROM idx"""))
def p25(spark, sf_dir):
    return presentation.present(inputs.index(spark, sf_dir).drop("data")).select("event_id", "display_severity")


# ---- filters and limits

A, B = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"


@query("f1_device_range", sql=idx_sql(f"""SELECT device_id, count(*) FILTER (event_time BETWEEN {A} AND {B}) AS closed, count(*) FILTER (event_time >= {A}) AS since,
  count(*) FILTER (event_time <= {B}) AS until FROM idx GROUP BY device_id"""))
def f1(spark, sf_dir):
    index = inputs.index(spark, sf_dir)
    ranges = {"closed": ("2024-01-05", "2024-01-20"), "since": ("2024-01-05", None), "until": (None, "2024-01-20")}
    out = index.select("device_id").distinct()
    for name, (start, end) in ranges.items():
        counted = filters.events_between(index, start, end).groupBy("device_id").agg(F.count(F.lit(1)).alias(name))
        out = out.join(counted, "device_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@query("f2_window_parameters", sql=idx_sql("""SELECT 'hours' AS query, count(*) AS n FROM idx WHERE event_time BETWEEN TIMESTAMP '2024-01-29 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'
  UNION ALL SELECT 'default', count(*) FROM idx WHERE event_time BETWEEN TIMESTAMP '2024-01-30 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'
  UNION ALL SELECT 'explicit', count(*) FROM idx WHERE event_time BETWEEN TIMESTAMP '2024-01-03 06:00:00' AND TIMESTAMP '2024-01-04 00:00:00'
  UNION ALL SELECT 'since', count(*) FROM idx WHERE event_time BETWEEN TIMESTAMP '2024-01-30 22:30:00' AND TIMESTAMP '2024-01-31 00:00:00'"""))
def f2(spark, sf_dir):
    index = inputs.index(spark, sf_dir)
    window = filters.QueryWindow.parse
    windows = {
        "hours": window({"hours": "48"}, inputs.AS_OF),
        "default": window({}, inputs.AS_OF),
        "explicit": window({"start": "2024-01-03T06:00:00Z", "end": "2024-01-04T00:00:00Z"}, inputs.AS_OF),
    }
    ranges = {k: (w.start, w.end) for k, w in windows.items()}
    now = filters.utc(inputs.AS_OF)
    ranges["since"] = (now - filters.parse_duration("1.5h"), now)
    parts = [
        filters.events_between(index, a, b).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("query"), "n") for k, (a, b) in ranges.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("f6_kind_sets", sql=idx_sql(f"SELECT kind, count(*) AS n FROM (SELECT {KIND} AS kind FROM idx) WHERE kind IN ('SERIAL', 'WATCHDOG', 'COLLECTOR') AND kind NOT IN ('COLLECTOR') GROUP BY kind"))
def f6(spark, sf_dir):
    shown = presentation.present(inputs.index(spark, sf_dir).drop("data"))
    return presentation.of_kinds(shown, ["SERIAL", "WATCHDOG", "COLLECTOR"], ["COLLECTOR"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("f7_log_contains", sql=idx_sql("SELECT event_id, line AS summary FROM idx WHERE et = 'purchase' AND contains(line, 'modem')"))
def f7(spark, sf_dir):
    return presentation.serial_log(inputs.index(spark, sf_dir).drop("data"), contains="modem").select("event_id", "summary")


@query("t6_serial_reconstruction", sql=idx_sql(f"""SELECT device_id, {iso('event_time')} AS event_time, {KIND} AS kind, {SUMMARY} AS summary
  FROM (SELECT * FROM idx WHERE et IN ('purchase', 'signup') QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_time, event_id) <= 10)"""))
def t6(spark, sf_dir):
    return presentation.serial_log(inputs.index(spark, sf_dir).drop("data"), include_collector=True, limit=10).select("device_id", "event_time", "kind", "summary")


@query("l1_newest_per_device", sql=idx_sql(f"""SELECT device_id, event_id, {iso('event_time')} AS event_time FROM idx
  QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_time DESC, event_id DESC) <= 5"""))
def l1(spark, sf_dir):
    return newest(inputs.index(spark, sf_dir).select("device_id", "event_id", "event_time"), ["device_id"], [F.col("event_time").desc(), F.col("event_id").desc()], 5)


@query("l1_oldest_per_device", sql=idx_sql(f"""SELECT device_id, event_id, {iso('event_time')} AS event_time FROM idx
  QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_time, event_id) <= 5"""))
def l1_oldest(spark, sf_dir):
    return newest(inputs.index(spark, sf_dir).select("device_id", "event_id", "event_time"), ["device_id"], [F.col("event_time").asc(), F.col("event_id").asc()], 5)


@query("l7_truncation", sql=idx_sql("SELECT device_id, count(*) AS row_count, count(*) >= 70 AS truncated FROM idx GROUP BY device_id"))
def l7(spark, sf_dir):
    return filters.truncated(inputs.index(spark, sf_dir), ["device_id"], 70)
