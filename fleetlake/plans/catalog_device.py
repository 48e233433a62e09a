"""Registered queries: device timeline, health, summary, anomalies, analytics and their aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake.operators.filters import QueryWindow
from fleetlake.plans import device, inputs
from fleetlake.plans.catalog_events import ARCHIVE_SQL
from fleetlake.plans.catalog_sequence import BURST_SQL, BURSTS, TIMELINE_ANOMALIES, WINDOW_MINUTES, event_slices
from fleetlake.plans.oracle import ANOMALIES, idx_sql, iso, num
from fleetlake.plans.registry import query

WEEK = "event_time BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'"
WEEK_IDX = f"wk AS MATERIALIZED (SELECT * FROM idx WHERE {WEEK})"


def week(limit: str | None = None, **more) -> QueryWindow:
    params = {"hours": "168", **({"limit": limit} if limit else {}), **more}
    return QueryWindow.parse(params, inputs.AS_OF, default_limit=1000)


def _text_times(columns):
    return ", ".join(f"{iso(c)} AS {c}" if c == "event_time" else c for c in columns)


@query("q1_device_timeline", sql=idx_sql(f"""SELECT {_text_times(device.TIMELINE_COLUMNS)} FROM wk
  QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_time DESC, event_id DESC) <= 10""", WEEK_IDX))
def q1(spark, sf_dir):
    return device.timeline(inputs.index(spark, sf_dir), week("10"))


@query("p19_timeline_row", sql=idx_sql(f"SELECT {_text_times(device.TIMELINE_COLUMNS)} FROM wk QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_time DESC, event_id DESC) <= 1000", WEEK_IDX))
def p19(spark, sf_dir):
    return device.timeline(inputs.index(spark, sf_dir), week())


def _stats(m: str) -> str:
    return (f"arg_max({m}, event_time) FILTER ({m} IS NOT NULL) AS {m}_latest, min({m}) AS {m}_min, max({m}) AS {m}_max, round(avg({m}), 9) AS {m}_average, count({m}) AS {m}_count, "
            f"CASE WHEN count({m}) > 1 THEN round(arg_max({m}, event_time) FILTER ({m} IS NOT NULL) - arg_min({m}, event_time) FILTER ({m} IS NOT NULL), 9) END AS {m}_change")


def _rounded(df, metrics=device.HEALTH_METRICS):
    return df.withColumns({f"{m}_{s}": F.round(f"{m}_{s}", 9) for m in metrics for s in ("average", "change")})


HEALTH_SQL = f"""SELECT device_id, count(*) AS event_count, {iso('min(event_time)')} AS first_event, {iso('max(event_time)')} AS last_event,
  {', '.join(_stats(m) for m in device.HEALTH_METRICS)}, arg_max(occupancy, event_time) FILTER (occupancy IS NOT NULL) AS occupancy_latest, sum(occupancy) AS occupancy_total,
  coalesce(string_agg(DISTINCT fw_version, ',' ORDER BY fw_version), '') AS firmware_versions, round(epoch_ms(max(event_time) - min(event_time)) / 3600000.0, 1) AS hours"""


@query("q2_device_health", sql=idx_sql(f"{HEALTH_SQL} FROM wk GROUP BY device_id", WEEK_IDX))
def q2(spark, sf_dir):
    return _rounded(device.health(inputs.index(spark, sf_dir), week()))


@query("q2_device_health_limited", sql=idx_sql(f"""{HEALTH_SQL} FROM (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_time, event_id) <= 8) GROUP BY device_id""", WEEK_IDX))
def q2_limited(spark, sf_dir):
    return _rounded(device.health(inputs.index(spark, sf_dir), week("8"), limited=True))


@query("a5_metric_stats", sql=idx_sql(f"SELECT device_id, {_stats('battery')}, {_stats('connect_time')} FROM idx GROUP BY device_id"))
def a5(spark, sf_dir):
    rows = inputs.index(spark, sf_dir).groupBy("device_id").agg(*device.metric_stats("battery"), *device.metric_stats("connect_time"))
    return _rounded(rows, ["battery", "connect_time"])


@query("a6_occupancy", sql=idx_sql("SELECT device_id, arg_max(occupancy, event_time) FILTER (occupancy IS NOT NULL) AS occupancy_latest, sum(occupancy) AS occupancy_total FROM idx GROUP BY device_id"))
def a6(spark, sf_dir):
    return device.health(inputs.index(spark, sf_dir)).select("device_id", "occupancy_latest", "occupancy_total")


@query("a7_time_span", sql=idx_sql(f"SELECT device_id, {iso('min(event_time)')} AS first_event, {iso('max(event_time)')} AS last_event, round(epoch_ms(max(event_time) - min(event_time)) / 3600000.0, 1) AS hours FROM idx GROUP BY device_id"))
def a7(spark, sf_dir):
    return device.health(inputs.index(spark, sf_dir)).select("device_id", "first_event", "last_event", "hours")


@query("a1_type_counts", sql=idx_sql("SELECT device_id, event_type, count(*) AS n FROM idx GROUP BY 1, 2"))
def a1(spark, sf_dir):
    return device.type_counts(inputs.index(spark, sf_dir))


@query("a2_plane_counts", sql=idx_sql("SELECT device_id, plane, count(*) AS n FROM idx GROUP BY 1, 2"))
def a2(spark, sf_dir):
    return device.plane_counts(inputs.index(spark, sf_dir))


@query("a3_name_counts", sql=idx_sql("SELECT device_id, event_name, count(*) AS n FROM idx GROUP BY 1, 2"))
def a3(spark, sf_dir):
    return device.name_counts(inputs.index(spark, sf_dir))


@query("a1_counts_in_one_pass", sql=idx_sql("""SELECT device_id, 'type' AS kind, event_type AS value, count(*) AS n FROM idx GROUP BY 1, 3 UNION ALL SELECT device_id, 'plane', plane, count(*) FROM idx GROUP BY 1, 3
  UNION ALL SELECT device_id, 'name', event_name, count(*) FROM idx GROUP BY 1, 3"""))
def a1_counts(spark, sf_dir):
    return device.counts(inputs.index(spark, sf_dir))


@query("a4_firmware_versions", sql=idx_sql("""SELECT device_id, coalesce(string_agg(DISTINCT fw_version, ',' ORDER BY fw_version), '') AS normalized,
  coalesce(string_agg(DISTINCT coalesce(fw_version, legacy_fw_version), ',' ORDER BY coalesce(fw_version, legacy_fw_version)), '') AS with_legacy,
  coalesce(string_agg(DISTINCT legacy_fw_version, ',' ORDER BY legacy_fw_version), '') AS legacy FROM idx GROUP BY device_id"""))
def a4(spark, sf_dir):
    return inputs.index(spark, sf_dir).groupBy("device_id").agg(
        device.version_list("fw_version").alias("normalized"), device.version_list("fw_version", "legacy_fw_version").alias("with_legacy"),
        device.version_list("legacy_fw_version").alias("legacy"),
    )


@query("a14_device_exists", sql=idx_sql("SELECT CAST(c_custkey AS VARCHAR) AS device_id FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT device_id FROM idx)"))
def a14(spark, sf_dir):
    devices = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("device_id"))
    return device.exists(inputs.index(spark, sf_dir), devices)


@query("q3_device_summary", sql=idx_sql(f"""SELECT w.device_id, event_count, telemetry_events, forensic_events, serial_events, firmware_versions, coalesce(anomaly_count, 0) AS anomaly_count,
    {iso('first_event')} AS first_event, {iso('last_event')} AS last_event, round(epoch_ms(last_event - first_event) / 3600000.0, 1) AS hours
  FROM (SELECT device_id, count(*) AS event_count, count(*) FILTER (plane = 'telemetry') AS telemetry_events, count(*) FILTER (plane = 'forensic') AS forensic_events, count(*) FILTER (plane = 'serial') AS serial_events,
      coalesce(string_agg(DISTINCT coalesce(fw_version, legacy_fw_version), ',' ORDER BY coalesce(fw_version, legacy_fw_version)), '') AS firmware_versions FROM wk GROUP BY 1) w
  JOIN (SELECT device_id, min(event_time) AS first_event, max(event_time) AS last_event FROM idx GROUP BY 1) e ON e.device_id = w.device_id
  LEFT JOIN (SELECT device_id, count(*) AS anomaly_count FROM anomalies GROUP BY 1) a ON a.device_id = w.device_id""", WEEK_IDX, ANOMALIES.format(src="wk")))
def q3(spark, sf_dir):
    return device.summary(inputs.index(spark, sf_dir), week(), slices=event_slices(spark, sf_dir))


@query("q4_device_anomalies", sql=idx_sql(f"SELECT device_id, {iso('event_time')} AS event_time, severity, type, message, value_num, value_str FROM anomalies WHERE severity IN ('medium', 'high')",
                                          "mon AS MATERIALIZED (SELECT * FROM idx)", ANOMALIES.format(src="mon")))
def q4(spark, sf_dir):
    window = QueryWindow.parse({"hours": "744", "severity": "medium"}, inputs.AS_OF, max_hours=744, default_limit=1000)
    return device.anomalies(inputs.index(spark, sf_dir), window, slices=event_slices(spark, sf_dir))


@query("q8_timeline_analytics", sql=idx_sql(f"""SELECT b.*, coalesce(g.gap_count, 0) AS gap_count, coalesce(u.burst_count, 0) AS burst_count, coalesce(f.anomaly_count, 0) AS anomaly_count FROM (
    SELECT device_id, count(*) AS event_count, {iso('min(event_time)')} AS first_event, {iso('max(event_time)')} AS last_event,
      coalesce(string_agg(DISTINCT legacy_fw_version, ',' ORDER BY legacy_fw_version), '') AS firmware_versions,
      count(*) FILTER (event_name = 'SERIAL_CONNECTED') AS serial_connected, count(*) FILTER (event_name = 'SERIAL_DISCONNECTED') AS serial_disconnected,
      count(*) FILTER (event_name = 'SERIAL_MISSING') AS serial_missing, count(*) FILTER (event_name = 'LOG') AS log,
      CAST(floor(avg(epoch_ms(received_at - event_time)) + 0.5) AS BIGINT) AS avg_delay_ms,
      CAST(min(epoch_ms(received_at - event_time)) AS DOUBLE) AS min_delay_ms, CAST(max(epoch_ms(received_at - event_time)) AS DOUBLE) AS max_delay_ms FROM idx GROUP BY 1) b
  LEFT JOIN (SELECT device_id, count(*) AS gap_count FROM (SELECT device_id, event_time - lag(event_time) OVER (PARTITION BY device_id ORDER BY event_time) AS g FROM idx) WHERE g > INTERVAL 720 MINUTE GROUP BY 1) g ON g.device_id = b.device_id
  LEFT JOIN (SELECT device_id, count(*) AS burst_count FROM bursts GROUP BY 1) u ON u.device_id = b.device_id
  LEFT JOIN (SELECT device_id, count(*) AS anomaly_count FROM found GROUP BY 1) f ON f.device_id = b.device_id""", BURST_SQL, BURSTS, TIMELINE_ANOMALIES))
def q8(spark, sf_dir):
    return device.timeline_analytics(inputs.index(spark, sf_dir), 720, WINDOW_MINUTES, event_slices(spark, sf_dir, WINDOW_MINUTES))


PAYLOAD = f"""pay AS MATERIALIZED (SELECT device_id, event_time, CASE WHEN readable AND n % 6 <> 0 THEN battery END AS battery,
    connect_time, reset_count, alert_count, temperature, legacy_fw_version AS fw_version FROM hex WHERE h <> 0)"""


@query("q9_payload_stats", sql=idx_sql(f"SELECT device_id, {', '.join(_stats(m) for m in device.HEALTH_METRICS)} FROM pay GROUP BY device_id", ARCHIVE_SQL, PAYLOAD))
def q9_stats(spark, sf_dir):
    return _rounded(device.payload_stats(inputs.index(spark, sf_dir), inputs.payloads(spark, sf_dir)))


PAYLOAD_FINDINGS = f"""per AS MATERIALIZED (SELECT device_id,
    arg_min(battery, event_time) FILTER (battery IS NOT NULL) AS b0, arg_max(battery, event_time) FILTER (battery IS NOT NULL) AS b1, count(battery) AS bn,
    arg_max(connect_time, event_time) FILTER (connect_time IS NOT NULL) AS c1, max(connect_time) AS cm, count(*) FILTER (connect_time > 180) AS cn,
    arg_min(reset_count, event_time) FILTER (reset_count IS NOT NULL) AS r0, arg_max(reset_count, event_time) FILTER (reset_count IS NOT NULL) AS r1, count(reset_count) AS rn,
    arg_max(alert_count, event_time) FILTER (alert_count IS NOT NULL) AS a1, count(*) FILTER (alert_count > 0) AS an FROM pay GROUP BY device_id),
  fwp AS (SELECT * FROM (SELECT device_id, event_time AS changed, fw_version AS nv, lag(fw_version) OVER (PARTITION BY device_id ORDER BY event_time) AS ov FROM pay WHERE fw_version IS NOT NULL) WHERE nv <> ov)"""


@query("r3_payload_anomalies", sql=idx_sql(f"""
  SELECT device_id, CASE WHEN b1 < 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'battery' AS metric, 'Battery critically low: ' || printf('%.1f', b1) || '%' AS message, b1 AS value_num, NULL::VARCHAR AS value_str, NULL::VARCHAR AS event_time FROM per WHERE b1 < 30
  UNION ALL SELECT device_id, 'MEDIUM', 'battery', 'Rapid battery drain: ' || printf('%.1f', b0 - b1) || '% drop (' || CAST(floor((b0 - b1) / b0 * 100 + 0.5) AS BIGINT) || '% of initial)', b0 - b1, NULL, NULL FROM per WHERE bn > 1 AND b0 - b1 > 30 AND (b0 - b1) / b0 * 100 > 30
  UNION ALL SELECT device_id, CASE WHEN c1 > 300 THEN 'HIGH' ELSE 'MEDIUM' END, 'connecttime', 'High connection time: ' || {num('c1')} || 's (threshold: 180s)', c1, NULL, NULL FROM per WHERE c1 > 180
  UNION ALL SELECT device_id, 'LOW', 'connecttime', cn || ' event(s) with connection time > 180s (max: ' || {num('cm')} || 's)', cm, NULL, NULL FROM per WHERE cm > 180
  UNION ALL SELECT device_id, CASE WHEN r1 - r0 > 3 THEN 'HIGH' ELSE 'MEDIUM' END, 'resets', 'Reset count increased by ' || {num('(r1 - r0)')} || ' (from ' || {num('r0')} || ' to ' || {num('r1')} || ')', r1 - r0, NULL, NULL FROM per WHERE rn > 1 AND r1 > r0
  UNION ALL SELECT device_id, CASE WHEN a1 > 0 THEN 'HIGH' ELSE 'MEDIUM' END, 'alerts', 'Active alerts detected: ' || an || ' event(s) with alerts > 0 (latest: ' || {num('a1')} || ')', a1, NULL, NULL FROM per WHERE an > 0
  UNION ALL SELECT device_id, 'LOW', 'firmware', 'Firmware changed from ' || ov || ' to ' || nv, NULL, ov || ' → ' || nv, {iso('changed')} FROM fwp""", ARCHIVE_SQL, PAYLOAD, PAYLOAD_FINDINGS))
def r3(spark, sf_dir):
    return device.payload_health(inputs.index(spark, sf_dir), inputs.payloads(spark, sf_dir), event_slices(spark, sf_dir))


@query("q9_payload_health", sql=idx_sql(f"""SELECT i.device_id, event_count, {iso('first_event')} AS first_event, {iso('last_event')} AS last_event, round(epoch_ms(last_event - first_event) / 3600000.0, 1) AS hours,
    coalesce(firmware_versions, '') AS firmware_versions, {', '.join(f"{m}_latest, {m}_count" for m in device.HEALTH_METRICS)}
  FROM (SELECT device_id, count(*) AS event_count, min(event_time) AS first_event, max(event_time) AS last_event FROM idx GROUP BY 1) i
  LEFT JOIN (SELECT device_id, string_agg(DISTINCT fw_version, ',' ORDER BY fw_version) AS firmware_versions, {', '.join(_stats(m) for m in device.HEALTH_METRICS)} FROM pay GROUP BY 1) p ON p.device_id = i.device_id""", ARCHIVE_SQL, PAYLOAD))
def q9(spark, sf_dir):
    rows = device.payload_summary(inputs.index(spark, sf_dir), inputs.payloads(spark, sf_dir))
    return rows.select("device_id", "event_count", "first_event", "last_event", "hours", "firmware_versions", *[f"{m}_{s}" for m in device.HEALTH_METRICS for s in ("latest", "count")])
