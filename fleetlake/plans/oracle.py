"""DuckDB common table expressions: the input adapter restated in SQL, independent of the operators."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def num(x: str) -> str:
    """Shortest number text."""
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


ARR = f"""base AS MATERIALIZED (
  SELECT event_id AS n, user_id AS u, event_type AS et, value, regexp_extract(props, '([0-9]+)', 1) AS ks,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, date_trunc('milliseconds', ts) AS t0,
    date_trunc('milliseconds', ts) + to_milliseconds(event_id * 37 % 9000) AS received_at
  FROM events),
named AS MATERIALIZED (
  SELECT *, CAST(u AS VARCHAR) AS uid,
    CASE WHEN n % 11 <> 0 OR n % 13 <> 0 THEN CAST(u AS VARCHAR) ELSE 'unknown' END AS device_id,
    CASE et WHEN 'view' THEN 'sensor-hook' WHEN 'click' THEN 'device-status' WHEN 'error' THEN 'watchdog-v2' ELSE 'serialLog' END AS event_name,
    n % 91 = 0 AS is_synthetic_time, CASE WHEN n % 91 = 0 THEN received_at ELSE t0 END AS event_time,
    CASE WHEN u % 3 = 0 THEN 'default' ELSE 'p' || (u % 3) END AS project_id,
    et = 'view' AND n % 4 <> 3 AS readable,
    CASE WHEN day(t0) <= 10 THEN 'v1' WHEN day(t0) <= 20 THEN 'v2' ELSE 'v3' END AS fw,
    CASE WHEN et = 'purchase' THEN (['[TRACE] ','[INFO] ','[WARN] ','[ERROR] ','[] '])[n % 5 + 1] ||
      (['modem ncp error -210','cloud disconnected','battery charge ok','watchdog fed','publishqueue depth 7','reboot requested','reconnect retry 3','idle'])[k % 8 + 1] END AS line
  FROM base),
keyed AS MATERIALIZED (
  SELECT *, {iso('event_time')} AS event_time_text,
    'events/' || substr({iso('event_time')}, 1, 10) || '/' || event_name || '/' || device_id || '/' ||
      regexp_replace({iso('event_time')}, '[:.]', '-', 'g') || '.json' AS archive_key
  FROM named),
arr AS MATERIALIZED (
  SELECT *, sha256(concat_ws(chr(0), device_id, event_name, event_time_text, archive_key)) AS event_id,
    CASE et WHEN 'view' THEN 'telemetry' WHEN 'click' THEN 'forensic' WHEN 'error' THEN 'forensic' ELSE 'serial' END AS plane,
    CASE et WHEN 'click' THEN 'telemetry.status' WHEN 'error' THEN 'fault.watchdog' WHEN 'purchase' THEN 'serial.log'
      WHEN 'signup' THEN (['serial.lifecycle.connected','serial.lifecycle.disconnected','serial.lifecycle.missing'])[n % 3 + 1]
      ELSE CASE WHEN n % 4 = 3 THEN 'telemetry.event' WHEN n % 10 = 9 THEN 'telemetry.health' ELSE 'telemetry.occupancy' END END AS event_type,
    CASE et WHEN 'purchase' THEN 'LOG' WHEN 'signup' THEN (['SERIAL_CONNECTED','SERIAL_DISCONNECTED','SERIAL_MISSING'])[n % 3 + 1] END AS source_event_type,
    CASE WHEN et IN ('purchase', 'signup') THEN 'serial-forwarder' ELSE 'cloud-webhook' END AS source_type,
    CASE WHEN et IN ('purchase', 'signup') THEN 'c' || (u % 5) END AS collector_id,
    CASE WHEN n % 4 = 1 THEN 'dev-' || uid END AS device_name,
    CASE WHEN n % 3 = 0 THEN 'prod' || (u % 4) END AS product_id,
    CASE WHEN et = 'purchase' AND n % 7 <> 0 THEN line END AS log_line,
    CASE WHEN et = 'view' AND n % 4 = 0 OR et = 'click' THEN 'object' WHEN et IN ('view', 'error') OR et = 'purchase' AND n % 7 = 0 THEN 'string' ELSE 'undefined' END AS data_type,
    CASE WHEN readable THEN CAST(k AS DOUBLE) END AS battery,
    CASE WHEN readable OR et = 'click' THEN value END AS connect_time,
    CASE WHEN readable THEN CAST(n // 1000 AS DOUBLE) END AS reset_count,
    CASE WHEN readable THEN CASE WHEN k % 10 = 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS alert_count,
    CASE WHEN readable AND n % 10 <> 9 THEN CAST(k % 7 AS DOUBLE) END AS occupancy,
    CASE WHEN readable AND n % 10 <> 9 THEN CAST(k * 2 AS DOUBLE) END AS daily_occupancy,
    CASE WHEN readable THEN 20 + k / 4.0 END::DOUBLE AS temperature,
    CASE WHEN et = 'view' THEN fw END AS fw_version,
    CASE WHEN et = 'view' AND n % 2 = 1 THEN fw END AS legacy_fw_version,
    CASE WHEN et = 'purchase' THEN (['TRACE','INFO','WARN','ERROR',CASE WHEN k % 8 = 0 THEN 'ERROR' END])[n % 5 + 1] END AS severity,
    line AS serial_log_line,
    CASE WHEN et = 'purchase' THEN (['modem','network','power','watchdog','queue','reset','network','other'])[k % 8 + 1] END AS serial_category,
    CASE WHEN et = 'signup' THEN (['connected','disconnected','missing'])[n % 3 + 1]
      WHEN et = 'purchase' AND k % 8 = 6 THEN 'reconnecting' WHEN et = 'purchase' AND k % 8 = 1 THEN 'disconnected' END AS network_state,
    CASE WHEN et IN ('purchase', 'signup') THEN coalesce(et = 'purchase' AND k % 8 = 6, false) END AS reconnect_detected,
    CASE WHEN et IN ('purchase', 'signup') THEN coalesce(et = 'purchase' AND k % 8 = 3, false) END AS watchdog_detected,
    CASE WHEN et IN ('purchase', 'signup') THEN coalesce(et = 'purchase' AND k % 8 = 5, false) END AS reset_detected,
    CASE WHEN et = 'purchase' AND k % 8 = 4 THEN 7.0 END::DOUBLE AS queue_depth
  FROM keyed)"""

IDX = """idx AS MATERIALIZED (
  SELECT * FROM arr QUALIFY row_number() OVER (PARTITION BY device_id, event_time_text ORDER BY received_at DESC, event_id DESC) = 1)"""

# Payload text as sent, and its digest.
SENT = """sent AS MATERIALIZED (SELECT n AS sent_n, data, sha256(coalesce(data, '') || chr(0) || coalesce(log_line, '') || chr(0) || coalesce(source_event_type, '')) AS digest FROM (
    SELECT n, log_line, source_event_type, CASE et WHEN 'error' THEN 'wdt fired' WHEN 'click' THEN '{"cloudRecoverStage":' || (k % 5) || ',"networkState":"up","queueDepth":' || ks || '}'
      WHEN 'purchase' THEN CASE WHEN n % 7 = 0 THEN line END
      WHEN 'view' THEN CASE n % 4 WHEN 0 THEN '{' || m || '}' WHEN 1 THEN replace('{' || m || '}', '"', '&quot;') WHEN 2 THEN replace(m || '}', '"', '&quot;') ELSE '{' || m END END AS data
    FROM (SELECT *, concat_ws(',', CASE WHEN n % 6 = 0 THEN '"Battery":' ELSE '"battery":' END || ks, '"connecttime":' || CAST(value AS VARCHAR), '"resets":' || (n // 1000),
      '"alerts":' || CASE WHEN k % 10 = 0 THEN '1' ELSE '0' END, CASE WHEN n % 10 <> 9 THEN '"occupancy":' || (k % 7) || ',"dailyoccupancy":"' || (k * 2) || '"' END,
      CASE WHEN n % 5 = 0 THEN '"temperature":' ELSE '"temp":' END || CAST(CAST(20 + k / 4.0 AS DOUBLE) AS VARCHAR), CASE WHEN n % 2 = 0 THEN '"fw_version":"' || fw || '"' END) AS m FROM arr)))"""

# Anomalies per device, used by several checks. ``{src}`` is the event relation.
ANOMALIES = f"""thr AS (
  SELECT device_id, event_time, CASE WHEN battery < 20 THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN battery < 20 THEN 'critical_battery' ELSE 'low_battery' END AS type,
    CASE WHEN battery < 20 THEN 'Critical' ELSE 'Low' END || ' battery level: ' || printf('%.1f', battery) || '%' AS message,
    battery AS value_num, NULL::VARCHAR AS value_str FROM {{src}} WHERE battery < 30
  UNION ALL SELECT device_id, event_time, CASE WHEN connect_time > 300 THEN 'high' ELSE 'medium' END,
    CASE WHEN connect_time > 300 THEN 'very_high_connect_time' ELSE 'high_connect_time' END,
    CASE WHEN connect_time > 300 THEN 'Very high connection time: ' || {num('connect_time')} || 's (threshold: 300s)'
      ELSE 'High connection time: ' || {num('connect_time')} || 's (threshold: 180s)' END,
    connect_time, NULL FROM {{src}} WHERE connect_time > 180
  UNION ALL SELECT device_id, event_time, 'high', 'active_alerts', 'Active alerts detected: ' || {num('alert_count')}, alert_count, NULL
    FROM {{src}} WHERE alert_count > 0),
fwc AS (
  SELECT * FROM (SELECT device_id, event_time AS changed_at, fw_version AS to_version,
    lag(fw_version) OVER (PARTITION BY device_id ORDER BY event_time) AS from_version FROM {{src}} WHERE fw_version IS NOT NULL)
  WHERE from_version <> to_version),
drain AS (
  SELECT *, (first_value - last_value) / first_value * 100 AS drop_percent, first_value - last_value AS "drop" FROM (
    SELECT device_id, arg_min(battery, event_time) AS first_value, arg_max(battery, event_time) AS last_value, max(event_time) AS last_at, count(*) AS readings
    FROM {{src}} WHERE battery IS NOT NULL GROUP BY device_id)
  WHERE readings > 1 AND first_value - last_value > 30 AND (first_value - last_value) / first_value * 100 > 30),
anomalies AS (
  SELECT * FROM thr
  UNION ALL SELECT device_id, changed_at, 'low', 'firmware_change', 'Firmware changed from ' || from_version || ' to ' || to_version, NULL, from_version || ' → ' || to_version FROM fwc
  UNION ALL SELECT device_id, last_at, 'medium', 'rapid_battery_drain',
    'Rapid battery drain: ' || printf('%.1f', "drop") || '% drop (' || CAST(floor(drop_percent + 0.5) AS BIGINT) || '% of initial)', "drop", NULL FROM drain)"""


def arr_sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([ARR, *ctes]) + "\n" + body


def idx_sql(body: str, *ctes: str) -> str:
    return arr_sql(body, IDX, *ctes)
