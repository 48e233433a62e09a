"""Registered queries: windows, sequences, rules, state fold, history and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake.operators import correlate, history, ledgers, rules, sequence, state
from fleetlake.operators.normalize import METRICS
from fleetlake.plans import inputs
from fleetlake.plans.catalog_events import ARCHIVE_SQL
from fleetlake.plans.device import correlation
from fleetlake.plans.oracle import ANOMALIES, SENT, arr_sql, idx_sql, iso, num
from fleetlake.plans.registry import query

DEVICE = ["device_id"]
WINDOW_MINUTES = 360


def event_slices(spark, sf_dir, window_minutes: float = 0):
    """Slices of large devices by event time; buckets hold two windows when windows are cut."""
    return inputs.slices(spark, sf_dir, DEVICE, "event_time", max(60, int(window_minutes * 120)))


def arrival_slices(spark, sf_dir, key=("device_id",), seconds: float = 30):
    return inputs.slices(spark, sf_dir, list(key), "received_at", max(60, int(2 * seconds)))


# ---- windows and sequences

@query("w1_gaps", sql=idx_sql(f"""SELECT device_id, {iso('gap_start')} AS gap_start, {iso('gap_end')} AS gap_end,
    CAST(floor(epoch_ms(gap_end - gap_start) / 60000.0 + 0.5) AS BIGINT) AS duration_minutes, event_before, event_after
  FROM (SELECT device_id, event_time AS gap_end, event_name AS event_after, lag(event_time) OVER w AS gap_start, lag(event_name) OVER w AS event_before
    FROM idx WINDOW w AS (PARTITION BY device_id ORDER BY event_time)) WHERE gap_end - gap_start > INTERVAL 720 MINUTE"""))
def w1(spark, sf_dir):
    return sequence.gaps(inputs.index(spark, sf_dir), 720, event_slices(spark, sf_dir))


@query("w2_firmware_changes", sql=idx_sql(f"SELECT device_id, {iso('changed_at')} AS changed_at, from_version, to_version FROM fwc", ANOMALIES.format(src="idx")))
def w2(spark, sf_dir):
    return rules.firmware_changes(inputs.index(spark, sf_dir), event_slices(spark, sf_dir))


@query("w3_battery_drain", sql=idx_sql(f"""SELECT device_id, first_value, last_value, {iso('last_at')} AS last_at, readings, "drop", round(drop_percent, 6) AS drop_percent FROM drain""", ANOMALIES.format(src="idx")))
def w3(spark, sf_dir):
    return rules.battery_drain(inputs.index(spark, sf_dir)).withColumn("drop_percent", F.round("drop_percent", 6))


@query("w4_reset_increase", sql=idx_sql("""SELECT device_id, last_value - first_value AS increase, CASE WHEN last_value - first_value > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM (SELECT device_id, arg_min(reset_count, event_time) AS first_value, arg_max(reset_count, event_time) AS last_value, count(*) AS c FROM idx WHERE reset_count IS NOT NULL GROUP BY 1)
  WHERE c > 1 AND last_value > first_value"""))
def w4(spark, sf_dir):
    return rules.reset_increase(inputs.index(spark, sf_dir)).select("device_id", "increase", "severity")


# Sequential walk over numbered times: t joins the open window, or opens the next one.
def walk(source: str, width: str, closed: bool = True, dense: str = "true") -> str:
    inside = f"e.t <= w.until" if closed else f"e.t < w.until"
    return f"""pts AS MATERIALIZED (SELECT device_id, t, bool_or(opens) AS opens, row_number() OVER (PARTITION BY device_id ORDER BY t) AS r
    FROM (SELECT device_id, t, coalesce({dense}, false) AS opens FROM {source}) GROUP BY device_id, t),
  walked AS (
    SELECT device_id, t, r, CASE WHEN opens THEN t END AS anchor, CASE WHEN opens THEN t + {width} END AS until FROM pts WHERE r = 1
    UNION ALL
    SELECT e.device_id, e.t, e.r, CASE WHEN {inside} THEN w.anchor WHEN e.opens THEN e.t END, CASE WHEN {inside} THEN w.until WHEN e.opens THEN e.t + {width} END
    FROM walked w JOIN pts e ON e.device_id = w.device_id AND e.r = w.r + 1)"""


WINDOWS_SQL = walk("(SELECT device_id, event_time AS t FROM idx)", "INTERVAL 360 MINUTE")
BURST_SQL = walk(
    "(SELECT device_id, event_time AS t, lead(event_time, 2) OVER (PARTITION BY device_id ORDER BY event_time) AS third FROM idx)",
    "INTERVAL 360 MINUTE", dense="third <= t + INTERVAL 360 MINUTE")
BURSTS = "bursts AS MATERIALIZED (SELECT i.device_id, anchor AS burst_start, max(i.event_time) AS burst_end, count(*) AS event_count FROM walked w JOIN idx i ON i.device_id = w.device_id AND i.event_time = w.t WHERE anchor IS NOT NULL GROUP BY 1, 2)"


@query("w5_anchored_windows", sql=idx_sql(f"""SELECT i.device_id, i.event_id, {iso('w.anchor')} AS window_start
  FROM walked w JOIN idx i ON i.device_id = w.device_id AND i.event_time = w.t""", WINDOWS_SQL))
def w5(spark, sf_dir):
    rows = inputs.index(spark, sf_dir).select(*DEVICE, "event_time", "event_id")
    return sequence.anchored_windows(rows, WINDOW_MINUTES, event_slices(spark, sf_dir, WINDOW_MINUTES)).select("device_id", "event_id", "window_start")


@query("w6_bursts", sql=idx_sql(f"SELECT device_id, {iso('burst_start')} AS burst_start, {iso('burst_end')} AS burst_end, event_count FROM bursts", BURST_SQL, BURSTS))
def w6(spark, sf_dir):
    return sequence.bursts(inputs.index(spark, sf_dir), WINDOW_MINUTES, 3, event_slices(spark, sf_dir, WINDOW_MINUTES))


@query("w6_burst_events", sql=idx_sql(f"""SELECT i.device_id, {iso('w.anchor')} AS window_start, i.event_name, {iso('i.event_time')} AS event_time
  FROM walked w JOIN idx i ON i.device_id = w.device_id AND i.event_time = w.t WHERE w.anchor IS NOT NULL""", BURST_SQL))
def w6_events(spark, sf_dir):
    rows = inputs.index(spark, sf_dir).select(*DEVICE, "event_time", "event_name")
    return sequence.burst_events(rows, WINDOW_MINUTES, 3, event_slices(spark, sf_dir, WINDOW_MINUTES))


# ---- rules over events

@query("r1_threshold_anomalies", sql=idx_sql(f"SELECT device_id, {iso('event_time')} AS event_time, severity, type, message, value_num FROM thr", ANOMALIES.format(src="idx")))
def r1(spark, sf_dir):
    return rules.threshold_anomalies(inputs.index(spark, sf_dir)).drop("value_str")


@query("r2_device_anomalies", sql=idx_sql(f"SELECT device_id, {iso('event_time')} AS event_time, severity, type, message, value_num, value_str FROM anomalies", ANOMALIES.format(src="idx")))
def r2(spark, sf_dir):
    return rules.device_anomalies(inputs.index(spark, sf_dir), event_slices(spark, sf_dir))


@query("f3_minimum_severity", sql=idx_sql(f"SELECT device_id, {iso('event_time')} AS event_time, severity, type FROM anomalies WHERE severity IN ('medium', 'high')", ANOMALIES.format(src="idx")))
def f3(spark, sf_dir):
    found = rules.device_anomalies(inputs.index(spark, sf_dir), event_slices(spark, sf_dir))
    return rules.at_least(found, "medium").select("device_id", "event_time", "severity", "type")


@query("l2_anomaly_order", sql=idx_sql(f"""SELECT device_id, {iso('event_time')} AS event_time, severity, type FROM anomalies
  ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, event_time DESC, device_id, type""", ANOMALIES.format(src="idx")))
def l2(spark, sf_dir):
    found = rules.device_anomalies(inputs.index(spark, sf_dir), event_slices(spark, sf_dir))
    return rules.by_severity_then_newest(found).select("device_id", "event_time", "severity", "type")


@query("a8_ingest_delay", sql=idx_sql("""SELECT device_id, CAST(floor(avg(epoch_ms(received_at - event_time)) + 0.5) AS BIGINT) AS avg_delay_ms,
  CAST(min(epoch_ms(received_at - event_time)) AS DOUBLE) AS min_delay_ms, CAST(max(epoch_ms(received_at - event_time)) AS DOUBLE) AS max_delay_ms FROM idx GROUP BY device_id"""))
def a8(spark, sf_dir):
    return sequence.ingest_delay(inputs.index(spark, sf_dir))


TIMELINE_ANOMALIES = f"""delays AS MATERIALIZED (SELECT *, CAST(epoch_ms(received_at - event_time) AS DOUBLE) AS d FROM idx),
  found AS MATERIALIZED (
    SELECT device_id, 'repeated_burst' AS type, 'medium' AS severity, NULL::VARCHAR AS event_time, 'Detected ' || count(*) || ' event bursts (3+ events within 360 minutes)' AS description
      FROM bursts GROUP BY device_id HAVING count(*) > 3
    UNION ALL SELECT device_id, 'high_ingest_delay', 'low', {iso('event_time')}, 'High ingest delay: ' || CAST(d AS BIGINT) || 'ms for ' || event_name
      FROM delays JOIN (SELECT device_id AS dev, floor(avg(d) + 0.5) AS a FROM delays GROUP BY 1) ON dev = device_id WHERE d > 5000 AND d > 2 * a)"""


@query("r4_timeline_anomalies", sql=idx_sql("SELECT * FROM found", BURST_SQL, BURSTS, TIMELINE_ANOMALIES))
def r4(spark, sf_dir):
    return sequence.timeline_anomalies(inputs.index(spark, sf_dir), WINDOW_MINUTES, slices=event_slices(spark, sf_dir, WINDOW_MINUTES))


# ---- state fold

LAST = "OVER (PARTITION BY project_id, device_id ORDER BY received_at, event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = "OVER (PARTITION BY project_id, device_id ORDER BY received_at, event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _last(column: str, alias: str | None = None) -> str:
    return f"last_value({column} IGNORE NULLS) {LAST} AS {alias or column}"


FLAGS = state.FLAGS
FOLD = f"""folded AS MATERIALIZED (SELECT n, project_id, device_id, event_id, event_time, event_time_text, received_at, event_type, plane, source_type, log_line, severity AS own_severity, fw_version AS own_fw, et, k, readable, line, event_name,
    {', '.join(_last(m) for m in METRICS)}, {', '.join(_last(f) for f in FLAGS)},
    {_last('fw_version')}, {_last('network_state')}, {_last('severity')},
    last_value(CASE WHEN plane = 'serial' THEN coalesce(serial_category, '') END IGNORE NULLS) {LAST} AS category_text,
    {_last("CASE WHEN event_type = 'serial.log' THEN serial_log_line END", 'last_serial_log_line')},
    first_value(device_name IGNORE NULLS) {LAST} AS device_name,
    CAST(count(*) FILTER (severity = 'ERROR') {LAST} AS BIGINT) AS recent_serial_error_count,
    {_last("CASE WHEN plane = 'telemetry' THEN event_time END", 'last_application_report_at')},
    last_value(fw_version IGNORE NULLS) {BEFORE} AS prev_fw_version, last_value(battery IGNORE NULLS) {BEFORE} AS prev_battery,
    lag(event_time) OVER (PARTITION BY project_id, device_id ORDER BY received_at, event_time, event_id) AS prev_event_time
  FROM arr),
judged AS MATERIALIZED (SELECT *,
    CASE WHEN plane = 'serial' THEN CASE WHEN own_severity = 'ERROR' OR watchdog_detected THEN 'critical' WHEN own_severity = 'WARN' OR reconnect_detected OR reset_detected THEN 'warning' END
      WHEN battery < 20 OR alert_count > 0 OR connect_time > 300 THEN 'critical' WHEN battery < 30 OR connect_time > 180 THEN 'warning'
      WHEN battery IS NOT NULL OR connect_time IS NOT NULL OR alert_count IS NOT NULL THEN 'healthy' ELSE 'unknown' END AS own_status,
    [x FOR x IN [
      CASE WHEN battery < 20 THEN 'critical_battery' WHEN battery < 30 THEN 'low_battery' END,
      CASE WHEN connect_time > 300 THEN 'very_high_connect_time' WHEN connect_time > 180 THEN 'high_connect_time' END,
      CASE WHEN alert_count > 0 THEN 'active_alerts' END,
      CASE WHEN own_severity = 'ERROR' THEN 'serial_error' WHEN own_severity = 'WARN' THEN 'serial_warning' END,
      CASE WHEN watchdog_detected THEN 'serial_watchdog' END, CASE WHEN reconnect_detected THEN 'serial_reconnect' END,
      CASE WHEN reset_detected THEN 'serial_reset' END] IF x IS NOT NULL] AS types
  FROM folded),
states AS MATERIALIZED (SELECT *, coalesce(last_value(own_status IGNORE NULLS) {LAST}, 'unknown') AS health_status, nullif(category_text, '') AS serial_category FROM judged),
cur AS MATERIALIZED (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY project_id, device_id ORDER BY received_at DESC, event_time DESC, event_id DESC) = 1)"""


def folded(spark, sf_dir):
    return state.state_history(inputs.arrivals(spark, sf_dir), arrival_slices(spark, sf_dir, state.KEY))


@query("w7_current_state", sql=arr_sql(f"""SELECT project_id, device_id, device_name, {iso('event_time')} AS last_event_time, {iso('last_application_report_at')} AS last_application_report_at,
    {iso('received_at')} AS last_ingest_time, event_type AS last_event_type, plane AS last_plane, source_type AS last_source_type, fw_version,
    {', '.join(METRICS)}, severity, network_state, serial_category, last_serial_log_line, recent_serial_error_count, {', '.join(FLAGS)}, health_status,
    CAST(len(types) AS BIGINT) AS anomaly_count, array_to_string(types, ',') AS anomaly_types FROM cur""", FOLD))
def w7(spark, sf_dir):
    rows = state.current_state(inputs.arrivals(spark, sf_dir), arrival_slices(spark, sf_dir, state.KEY))
    return rows.drop("last_event_id").withColumns({
        "anomaly_count": F.col("anomaly_count").cast("bigint"),
        "anomaly_types": F.array_join(F.transform("anomalies", lambda a: a["type"]), ","),
    }).drop("anomalies")


@query("w8_health_carry_forward", sql=arr_sql("SELECT event_id, health_status FROM states", FOLD))
def w8(spark, sf_dir):
    return folded(spark, sf_dir).select("event_id", "health_status")


@query("w9_serial_error_count", sql=arr_sql("SELECT event_id, recent_serial_error_count FROM states", FOLD))
def w9(spark, sf_dir):
    return folded(spark, sf_dir).select("event_id", "recent_serial_error_count")


@query("w10_last_application_report", sql=arr_sql(f"SELECT event_id, {iso('last_application_report_at')} AS last_application_report_at FROM states", FOLD))
def w10(spark, sf_dir):
    return folded(spark, sf_dir).select("event_id", "last_application_report_at")


@query("j9_previous_state", sql=arr_sql(f"SELECT event_id, prev_fw_version, prev_battery, {iso('prev_event_time')} AS prev_event_time FROM states", FOLD))
def j9(spark, sf_dir):
    return folded(spark, sf_dir).select("event_id", "prev_fw_version", "prev_battery", "prev_event_time")


@query("r5_state_anomalies", sql=arr_sql("SELECT event_id, array_to_string(types, ',') AS types FROM states", FOLD))
def r5(spark, sf_dir):
    return folded(spark, sf_dir).select("event_id", F.array_join(F.transform("anomalies", lambda a: a["type"]), ",").alias("types"))


@query("r6_own_health", sql=arr_sql("SELECT event_id, own_status FROM states", FOLD))
def r6(spark, sf_dir):
    return folded(spark, sf_dir).select("event_id", "own_status")


UPSERTED = [
    *METRICS, *FLAGS, "fw_version", "network_state", "severity", "serial_category", "device_name", "serial_log_line", "event_type", "plane", "source_type",
    "event_id", "event_time", "received_at",
]
INSTANTS = ("event_time", "received_at")


def _upsert_sql() -> str:
    last = ", ".join(f"arg_max({c}, (received_at, event_time, event_id)) FILTER ({c} IS NOT NULL) AS {c}" for c in UPSERTED)
    parts = ", ".join(f"{name} AS MATERIALIZED (SELECT project_id, device_id, {last} FROM arr WHERE received_at {op} TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1, 2)" for name, op in (("one", "<"), ("two", ">=")))
    both = {c: f"coalesce(b.{c}, a.{c})" for c in ["project_id", "device_id", *UPSERTED]}
    merged = ", ".join(f"{iso(v) if c in INSTANTS else v} AS {c}" for c, v in both.items())
    return arr_sql(f"SELECT {merged} FROM one a FULL OUTER JOIN two b ON a.project_id = b.project_id AND a.device_id = b.device_id", parts)


@query("s5_state_upsert", sql=_upsert_sql())
def s5(spark, sf_dir):
    def last(condition):
        rows = inputs.arrivals(spark, sf_dir).filter(condition)
        position = F.struct(*state.ARRIVAL_ORDER)
        return rows.groupBy(*state.KEY).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in UPSERTED])

    cut = F.lit("2024-01-25").cast("timestamp")
    return state.merge_state(last(F.col("received_at") < cut), last(F.col("received_at") >= cut), UPSERTED)


# ---- history

RAW_ITEMS = """items AS MATERIALIZED (
  SELECT n, device_id, event_id, event_time, event_time_text, 'ANOMALY' AS event_type, array_to_string(types, ',') AS types, NULL::VARCHAR AS from_fw, NULL::VARCHAR AS to_fw, NULL::DOUBLE AS battery_level FROM states WHERE len(types) > 0
  UNION ALL SELECT n, device_id, event_id, event_time, event_time_text, 'FIRMWARE_UPDATE', NULL, prev_fw_version, own_fw, NULL FROM states WHERE own_fw <> prev_fw_version
  UNION ALL SELECT n, device_id, event_id, event_time, event_time_text, 'BATTERY_CRITICAL', NULL, NULL, NULL, battery FROM states WHERE battery < 20 AND NOT coalesce(prev_battery < 20, false)
  UNION ALL SELECT n, device_id, event_id, event_time, event_time_text, 'DEVICE_RECOVERED', NULL, NULL, NULL, NULL FROM states
    WHERE event_time > prev_event_time AND prev_event_time < event_time - INTERVAL 3 HOUR AND event_time >= received_at - INTERVAL 3 HOUR)"""


def derived(spark, sf_dir):
    return history.derive_history(folded(spark, sf_dir))


@query("h1_anomaly_history", sql=arr_sql(f"SELECT device_id, {iso('event_time')} AS report_time, types FROM items WHERE event_type = 'ANOMALY'", FOLD, RAW_ITEMS))
def h1(spark, sf_dir):
    rows = derived(spark, sf_dir).filter(F.col("event_type") == "ANOMALY")
    return rows.select("device_id", "report_time", F.array_join(F.transform("anomalies", lambda a: a["type"]), ",").alias("types"))


@query("h2_firmware_updates", sql=arr_sql(f"SELECT device_id, {iso('event_time')} AS report_time, from_fw AS from_fw_version, to_fw AS to_fw_version FROM items WHERE event_type = 'FIRMWARE_UPDATE'", FOLD, RAW_ITEMS))
def h2(spark, sf_dir):
    return derived(spark, sf_dir).filter(F.col("event_type") == "FIRMWARE_UPDATE").select("device_id", "report_time", "from_fw_version", "to_fw_version")


@query("h3_battery_critical", sql=arr_sql(f"SELECT device_id, {iso('event_time')} AS report_time, battery_level FROM items WHERE event_type = 'BATTERY_CRITICAL'", FOLD, RAW_ITEMS))
def h3(spark, sf_dir):
    return derived(spark, sf_dir).filter(F.col("event_type") == "BATTERY_CRITICAL").select("device_id", "report_time", "battery_level")


@query("h4_device_recovered", sql=arr_sql(f"SELECT device_id, {iso('event_time')} AS report_time FROM items WHERE event_type = 'DEVICE_RECOVERED'", FOLD, RAW_ITEMS))
def h4(spark, sf_dir):
    return derived(spark, sf_dir).filter(F.col("event_type") == "DEVICE_RECOVERED").select("device_id", "report_time")


@query("h6_history_key", sql=arr_sql(f"""SELECT device_id, event_type, event_time_text || '#' || event_type || '#' || event_id || '#' || substr(sha256(concat_ws('&', 'anomalies=' || types,
    'batteryLevel=' || {num('battery_level')}, 'fromFwVersion=' || from_fw, 'payload=' || digest, 'toFwVersion=' || to_fw)), 1, 32) AS history_key
  FROM items JOIN sent ON sent_n = n""", FOLD, RAW_ITEMS, SENT))
def h6(spark, sf_dir):
    return derived(spark, sf_dir).select("device_id", "event_type", "history_key")


@query("s6_history_append", sql=arr_sql(f"""SELECT device_id, event_type, {iso('event_time')} AS report_time FROM items WHERE event_time >= TIMESTAMP '2024-01-20 00:00:00'""", FOLD, RAW_ITEMS))
def s6(spark, sf_dir):
    """A replay delivers everything twice; only rows not stored before are appended."""
    rows = derived(spark, sf_dir)
    stored = rows.filter(F.col("report_time") < F.lit("2024-01-20").cast("timestamp"))
    return history.append_new(stored, rows.unionByName(rows)).select("device_id", "event_type", "report_time")


# ---- correlation

MEMBER_SQL = f"""mem AS MATERIALIZED (
  SELECT h.*, w.anchor AS window_start, CASE h.et WHEN 'error' THEN 'watchdog' WHEN 'click' THEN 'status' WHEN 'signup' THEN 'lifecycle' WHEN 'purchase' THEN 'log' ELSE 'telemetry' END AS class,
    h <> 0 AS paid, CASE WHEN h <> 0 AND readable THEN CASE WHEN n % 6 <> 0 THEN battery END END AS b,
    CASE WHEN h <> 0 AND readable THEN connect_time END AS c, CASE WHEN h <> 0 AND readable THEN alert_count END AS a, CASE WHEN h <> 0 AND readable THEN reset_count END AS r,
    CASE WHEN h.et = 'purchase' THEN CASE WHEN n % 7 = 0 THEN 'other' ELSE (['modem','network','power',
      CASE WHEN n % 5 = 3 THEN 'error' ELSE 'other' END, CASE WHEN n % 5 = 3 THEN 'error' ELSE 'other' END, CASE WHEN n % 5 = 3 THEN 'error' ELSE 'other' END,'reconnect',CASE WHEN n % 5 = 3 THEN 'error' ELSE 'other' END])[k % 8 + 1] END END AS cat
  FROM hex h JOIN walked w ON w.device_id = h.device_id AND w.t = h.event_time),
win AS MATERIALIZED (
  SELECT device_id, window_start, max(event_time) AS window_end, count(*) AS event_count,
    count(*) FILTER (class = 'telemetry' AND paid AND readable) AS n_telemetry, count(*) FILTER (class = 'watchdog' AND paid) AS n_watchdog,
    count(*) FILTER (class = 'status' AND paid) AS n_status, count(*) FILTER (class = 'lifecycle') AS n_lifecycle, count(*) FILTER (class = 'log') AS n_log,
    max(c) AS max_connect, min(CASE WHEN b <> 0 THEN b END) AS min_battery, max(a) AS max_alerts,
    count(*) FILTER (cat IN ('modem', 'error')) AS n_modem, count(*) FILTER (cat = 'reconnect') AS n_reconnect,
    count(*) FILTER (source_event_type = 'SERIAL_CONNECTED') AS n_connected, count(*) FILTER (source_event_type = 'SERIAL_DISCONNECTED') AS n_disconnected,
    count(r) AS n_resets, arg_min(r, event_time) FILTER (r IS NOT NULL) AS first_resets, arg_max(r, event_time) FILTER (r IS NOT NULL) AS last_resets
  FROM mem GROUP BY 1, 2),
fired AS MATERIALIZED (SELECT *,
    coalesce(n_telemetry > 0 AND n_log > 0 AND max_connect > 60 AND n_modem > 0, false) AS r1, n_connected > 1 OR n_disconnected > 1 AS r2,
    coalesce(n_watchdog > 0 AND n_telemetry > 0 AND max_connect > 120, false) AS r3, coalesce(n_watchdog > 0 AND n_telemetry > 1 AND n_resets > 1 AND last_resets > first_resets, false) AS r4,
    coalesce(min_battery < 30 AND max_alerts > 0, false) AS r5, n_reconnect >= 2 AS r6 FROM win),
inf AS MATERIALIZED (
  SELECT device_id, window_start, 1 AS rule, 'WARNING' AS severity, 'connectivity' AS category, 'Connectivity degradation detected: High connection time with modem errors' AS message FROM fired WHERE r1
  UNION ALL SELECT device_id, window_start, 2, 'WARNING', 'hardware', 'USB instability detected: ' || n_connected || ' connect, ' || n_disconnected || ' disconnect events' FROM fired WHERE r2
  UNION ALL SELECT device_id, window_start, 3, 'CRITICAL', 'connectivity', 'Network stall likely caused watchdog reset' FROM fired WHERE r3
  UNION ALL SELECT device_id, window_start, 4, 'CRITICAL', 'stability', 'Device reboot detected: reset count increased by ' || CAST(last_resets - first_resets AS BIGINT) FROM fired WHERE r4
  UNION ALL SELECT device_id, window_start, 5, 'CRITICAL', 'power', 'Power anomaly: Low battery with active alerts' FROM fired WHERE r5
  UNION ALL SELECT device_id, window_start, 6, 'WARNING', 'connectivity', 'Reconnect loop detected: ' || n_reconnect || ' reconnect attempts' FROM fired WHERE r6
  UNION ALL SELECT device_id, window_start, 7, 'WARNING', 'connectivity', 'High cellular connection time detected' FROM fired WHERE max_connect > 180 AND NOT (r1 OR r3 OR r6)
  UNION ALL SELECT device_id, window_start, 8, 'CRITICAL', 'power', 'Critical battery level detected' FROM fired WHERE min_battery < 20 AND NOT r5)"""
CORRELATION = (ARCHIVE_SQL, WINDOWS_SQL, MEMBER_SQL)


def correlated(spark, sf_dir, reused=False):
    return correlation(
        inputs.index(spark, sf_dir), inputs.payloads(spark, sf_dir), WINDOW_MINUTES, event_slices(spark, sf_dir, WINDOW_MINUTES), reused
    )


@query("r7_window_assembly", sql=idx_sql(f"""SELECT device_id, {iso('window_start')} AS window_start, {iso('window_end')} AS window_end,
  round(epoch_ms(window_end - window_start) / 60000.0, 1) AS duration_minutes, event_count, n_telemetry, n_watchdog, n_status, n_lifecycle, n_log FROM win""", *CORRELATION))
def r7(spark, sf_dir):
    _, windows, _ = correlated(spark, sf_dir)
    return windows.select("device_id", "window_start", "window_end", "duration_minutes", "event_count", "n_telemetry", "n_watchdog", "n_status", "n_lifecycle", "n_log")


INFERENCE_RULES = {
    1: "i1_modem_connectivity", 2: "i2_usb_instability", 3: "i3_network_stall", 4: "i4_reboot", 5: "i5_power_anomaly",
    6: "i6_reconnect_loop", 7: "i7_high_connect", 8: "i8_critical_battery",
}


def _inference(rule: int):
    def build(spark, sf_dir):
        _, _, found = correlated(spark, sf_dir)
        return found.filter(F.col("rule") == rule).select("device_id", "window_start", "severity", "category", "message")

    return build


for _rule, _name in INFERENCE_RULES.items():
    query(_name, sql=idx_sql(f"SELECT device_id, {iso('window_start')} AS window_start, severity, category, message FROM inf WHERE rule = {_rule}", *CORRELATION))(_inference(_rule))


@query("i9_evidence", sql=idx_sql(f"""SELECT m.device_id, {iso('m.window_start')} AS window_start, e.rule, e.part, e.line FROM mem m, LATERAL (
    SELECT * FROM (VALUES
      (1, 1, CASE WHEN c > 60 AND class = 'telemetry' THEN 'connecttime=' || {num('c')} || 's at ' || {iso('event_time')} END),
      (1, 2, CASE WHEN cat IN ('modem', 'error') THEN cat || ': ' || substr(coalesce(log_line, ''), 1, 60) END),
      (2, 1, CASE WHEN class = 'lifecycle' THEN source_event_type || ' at ' || {iso('event_time')} END),
      (3, 1, CASE WHEN class = 'watchdog' AND paid THEN 'watchdog: ' || CASE WHEN h % 2 = 0 THEN 'cause-' || h ELSE event_name END || ' at ' || {iso('event_time')} END),
      (3, 2, CASE WHEN c > 120 AND class = 'telemetry' THEN 'connecttime=' || {num('c')} || 's at ' || {iso('event_time')} END),
      (4, 1, CASE WHEN class = 'watchdog' AND paid THEN 'watchdog: ' || CASE WHEN h % 2 = 0 THEN 'cause-' || h ELSE event_name END END),
      (5, 1, CASE WHEN (b <> 0 AND b < 30) OR a > 0 THEN 'battery=' || coalesce({num('b')}, 'undefined') || '%, alerts=' || coalesce({num('a')}, 'undefined') || ' at ' || {iso('event_time')} END),
      (6, 1, CASE WHEN cat = 'reconnect' THEN substr(log_line, 1, 60) || ' at ' || {iso('event_time')} END),
      (7, 1, CASE WHEN c > 180 AND class = 'telemetry' THEN 'connecttime=' || {num('c')} || 's at ' || {iso('event_time')} END),
      (8, 1, CASE WHEN b <> 0 AND b < 20 THEN 'battery=' || {num('b')} || '% at ' || {iso('event_time')} END)) v(rule, part, line)
    WHERE line IS NOT NULL) e JOIN inf i ON i.device_id = m.device_id AND i.window_start = m.window_start AND i.rule = e.rule
  UNION ALL SELECT device_id, {iso('window_start')}, 4, 2, 'reset count: ' || {num('first_resets')} || ' → ' || {num('last_resets')} FROM fired WHERE r4""", *CORRELATION))
def i9(spark, sf_dir):
    members, _, found = correlated(spark, sf_dir, reused=True)
    return correlate.evidence(members, found).select("device_id", "window_start", "rule", "part", "line")


@query("a13_inference_summary", sql=idx_sql("""SELECT device_id, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning,
  count(*) FILTER (severity = 'INFO') AS info, count(*) FILTER (category = 'connectivity') AS connectivity, count(*) FILTER (category = 'power') AS power,
  count(*) FILTER (category = 'stability') AS stability, count(*) FILTER (category = 'hardware') AS hardware FROM inf GROUP BY device_id""", *CORRELATION))
def a13(spark, sf_dir):
    _, _, found = correlated(spark, sf_dir)
    return correlate.inference_summary(found)


@query("q10_correlation", sql=idx_sql(f"""SELECT w.device_id, {iso('w.window_start')} AS window_start, w.event_count, i.rule, i.severity, i.category, i.message
  FROM win w JOIN inf i ON i.device_id = w.device_id AND i.window_start = w.window_start""", *CORRELATION))
def q10(spark, sf_dir):
    _, _, found = correlated(spark, sf_dir)
    return found.select("device_id", "window_start", "event_count", "rule", "severity", "category", "message")


# ---- throttled refresh, product ids

RESOLVED = """resolved AS MATERIALIZED (SELECT *, coalesce(last_value(product_id IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY received_at, event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    CASE WHEN u % 2 = 0 AND device_id <> 'unknown' THEN 'lookup' END) AS resolved_product_id FROM arr)"""
ELIGIBLE = "event_name IN ('sensor-hook', 'device-status') AND (device_id IN ('7', '8', '9') OR resolved_product_id IN ('prod1', 'lookup'))"


def product_lookup(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "customer")
    return c.filter(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").cast("string").alias("device_id"), F.lit("lookup").alias("product_id"))


def resolved(spark, sf_dir):
    return ledgers.resolve_product(inputs.arrivals(spark, sf_dir), product_lookup(spark, sf_dir), arrival_slices(spark, sf_dir))


@query("j4_product_resolution", sql=arr_sql("SELECT event_id, resolved_product_id FROM resolved", RESOLVED))
def j4(spark, sf_dir):
    return resolved(spark, sf_dir).select("event_id", "resolved_product_id")


@query("f8_refresh_eligibility", sql=arr_sql(f"SELECT event_id FROM resolved WHERE {ELIGIBLE}", RESOLVED))
def f8(spark, sf_dir):
    return _eligible(spark, sf_dir).select("event_id")


def _eligible(spark, sf_dir):
    return ledgers.refresh_eligible(resolved(spark, sf_dir), ["sensor-hook", "device-status"], ["7", "8", "9"], ["prod1", "lookup"])


@query("w11_throttled_refresh", sql=arr_sql("""SELECT device_id, event_id FROM (SELECT r.*, row_number() OVER (PARTITION BY r.device_id, r.received_at ORDER BY event_id) AS pick
    FROM elig r JOIN walked w ON w.device_id = r.device_id AND w.t = r.received_at AND w.anchor = w.t) WHERE pick = 1""",
    RESOLVED, f"elig AS MATERIALIZED (SELECT * FROM resolved WHERE {ELIGIBLE})",
    walk("(SELECT device_id, received_at AS t FROM elig)", "INTERVAL 12 HOUR", closed=False)))
def w11(spark, sf_dir):
    rows = _eligible(spark, sf_dir).select("device_id", "event_id", "received_at")
    return sequence.throttled(rows, 12 * 3600, slices=arrival_slices(spark, sf_dir, seconds=12 * 3600)).select("device_id", "event_id")
