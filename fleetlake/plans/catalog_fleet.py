"""Registered queries: ledgers, inventory, fleet counters, schedule and the fleet report."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake.operators import filters, fleet, history, ledgers, overlay, schedule, state
from fleetlake.functions.values import age_text, iso as iso_text
from fleetlake.plans import inputs
from fleetlake.plans.catalog_sequence import FOLD
from fleetlake.plans.oracle import AS_OF, arr_sql, iso
from fleetlake.plans.registry import query
from fleetlake.sources.inventory import INVENTORY_COLUMNS, explode_pages

PRODUCT = "product-default"
TRIGGER_NAME = "sensor-hook"


def plain(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body


# ---- ledgers

FETCH = """fet AS MATERIALIZED (SELECT *, CASE WHEN code IS NULL THEN 'network_failure' WHEN code = 401 THEN 'auth_failure' WHEN code = 404 THEN 'missing_ledger' WHEN code = 503 THEN 'retryable_failure'
      WHEN code = 418 THEN 'permanent_failure' WHEN seq % 29 = 0 THEN 'malformed_json' WHEN seq % 31 = 0 THEN 'permanent_failure' ELSE 'ok' END AS outcome
    FROM (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'device-settings' WHEN o_orderkey % 6 = 5 THEN 'device-data' ELSE 'device-status' END AS ledger_name, CAST(o_custkey AS VARCHAR) AS scope_value, o_orderdate AS od,
      o_orderdate + to_seconds(o_orderkey % 86400) AS fetched_at, CAST(floor(o_totalprice) AS BIGINT) % 120 AS soc,
      CASE o_orderstatus WHEN 'P' THEN CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 200 END WHEN 'O' THEN CASE WHEN o_orderkey % 10 = 3 THEN 401 ELSE 404 END ELSE CASE WHEN o_orderkey % 10 = 3 THEN 418 ELSE 503 END END AS code
      FROM orders)),
  timed AS MATERIALIZED (SELECT *, CASE WHEN outcome = 'ok' AND seq % 23 <> 0 THEN od END AS updated_at, ledger_name = 'device-settings' AND outcome = 'missing_ledger' AS clears FROM fet),
  eras AS MATERIALIZED (SELECT *, count(*) FILTER (clears) OVER (PARTITION BY scope_value, ledger_name ORDER BY fetched_at, seq) AS era FROM timed),
  acc AS MATERIALIZED (SELECT *, CASE WHEN clears THEN 'cleared' WHEN outcome <> 'ok' THEN 'failed' WHEN updated_at IS NULL THEN 'missing_updated_at' WHEN before IS NULL OR updated_at > before THEN 'updated' ELSE 'stale' END AS effect
    FROM (SELECT *, max(updated_at) OVER (PARTITION BY scope_value, ledger_name, era ORDER BY fetched_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM eras)),
  stored AS MATERIALIZED (SELECT * FROM acc WHERE effect IN ('updated', 'cleared') QUALIFY row_number() OVER (PARTITION BY scope_value, ledger_name ORDER BY fetched_at DESC, seq DESC) = 1)"""


def fetch_slices(spark, sf_dir):
    return inputs.slices(spark, sf_dir, ledgers.FETCH_KEY, "fetched_at", source="fetches")


def accepted(spark, sf_dir):
    return ledgers.accept(ledgers.classify_fetches(inputs.ledger_fetches(spark, sf_dir)), fetch_slices(spark, sf_dir))


@query("s8_ledger_outcomes", sql=plain(f"""SELECT seq, ledger_name, scope_value, CAST(code AS BIGINT) AS http_status, outcome, outcome IN ('retryable_failure', 'network_failure') AS retryable, {iso('updated_at')} AS updated_at FROM timed""", FETCH))
def s8(spark, sf_dir):
    rows = ledgers.classify_fetches(inputs.ledger_fetches(spark, sf_dir))
    return rows.select("seq", "ledger_name", "scope_value", F.col("http_status").cast("bigint").alias("http_status"), "outcome", "retryable", "updated_at")


@query("j5_ledger_upsert", sql=plain("SELECT seq, effect FROM acc", FETCH))
def j5(spark, sf_dir):
    return accepted(spark, sf_dir).select("seq", "effect")


@query("j6_stored_snapshots", sql=plain(f"""SELECT scope_value, ledger_name, {iso('fetched_at')} AS fetched_at, CASE WHEN effect = 'updated' THEN {iso('updated_at')} END AS updated_at FROM stored""", FETCH))
def j6(spark, sf_dir):
    return ledgers.stored_snapshots(accepted(spark, sf_dir)).select("scope_value", "ledger_name", "fetched_at", "updated_at")


@query("j7_reset_projection", sql=plain("""SELECT scope_value, arg_max(CAST(seq % 9 AS DOUBLE), (fetched_at, seq)) AS firmware_reset_count,
    arg_max(CAST(seq % 6 AS DOUBLE), (fetched_at, seq)) FILTER (seq % 5 = 0) AS startup_reset_count
  FROM acc WHERE effect = 'updated' AND ledger_name = 'device-status' AND seq % 3 <> 2 GROUP BY 1""", FETCH))
def j7(spark, sf_dir):
    return ledgers.reset_projection(accepted(spark, sf_dir))


@query("h5_ledger_sync_failed", sql=plain(f"""SELECT scope_value AS device_id, {iso('fetched_at')} AS report_time, outcome AS error_kind, CAST(code AS BIGINT) AS http_status
  FROM acc WHERE ledger_name = 'device-status' AND outcome <> 'ok'""", FETCH))
def h5(spark, sf_dir):
    rows = history.sync_failures(ledgers.sync_failures(accepted(spark, sf_dir)), iso_text(F.col("fetched_at")))
    return rows.select("device_id", "report_time", "error_kind", F.col("http_status").cast("bigint").alias("http_status"))


def fetches_of(arrivals):
    """Refresh triggers among the arrivals, and what each fetch returned by the first letter of its event id."""
    triggers = arrivals.filter(F.col("event_name") == TRIGGER_NAME)
    letter = F.substring("event_id", 1, 1)
    return triggers, triggers.select(
        "project_id", F.col("device_id").alias("scope_value"), F.lit("device-status").alias("ledger_name"), F.timestamp_micros(F.unix_micros("received_at") + 250_000).alias("fetched_at"), F.col("event_id").alias("trigger_event_id"),
        F.when(letter < "3", 503).when(letter < "4", 404).when(letter < "5", F.lit(None)).otherwise(200).alias("http_status"), F.lit("{}").alias("body"),
    )


def triggered_fetches(spark, sf_dir):
    return fetches_of(inputs.arrivals(spark, sf_dir))


def landed_fetches(spark, sf_dir):
    """The same fetches from the raw bodies: they need who and when, so that no payload is read and no table written for them."""
    return fetches_of(inputs.arrivals_from_raw(spark, sf_dir))[1]


TRIGGERED = """trig AS MATERIALIZED (SELECT *, CASE WHEN c < '3' THEN 503 WHEN c < '4' THEN 404 WHEN c < '5' THEN NULL ELSE 200 END AS http_status,
      CASE WHEN c < '3' THEN 'retryable_failure' WHEN c < '4' THEN 'missing_ledger' WHEN c < '5' THEN 'network_failure' ELSE 'permanent_failure' END AS error_kind
    FROM (SELECT *, substr(event_id, 1, 1) AS c FROM arr WHERE et = 'view'))"""


@query("h5_triggered_failures", sql=arr_sql(f"""SELECT device_id, {iso('event_time')} AS report_time, error_kind, CAST(http_status AS BIGINT) AS http_status,
    event_time_text || '#LEDGER_SYNC_FAILED#' || event_id || '#' || substr(sha256('errorKind=' || error_kind || coalesce('&httpStatus=' || http_status, '')), 1, 32) AS history_key
  FROM trig""", TRIGGERED))
def h5_triggered(spark, sf_dir):
    triggers, raw = triggered_fetches(spark, sf_dir)
    fetches = ledgers.classify_fetches(raw)
    rows = history.sync_failures(fetches.filter(F.col("outcome") != "ok"), iso_text(F.col("fetched_at")), triggers)
    return rows.select("device_id", "report_time", "error_kind", F.col("http_status").cast("bigint").alias("http_status"), "history_key")


def _ledger_sql(alias: str, prefix: str) -> str:
    updated = f"CASE WHEN {alias}.effect = 'updated' THEN {alias}.updated_at END"
    return f"{iso(updated)} AS {prefix}_updated_at, {iso(alias + '.fetched_at')} AS {prefix}_fetched_at"


@query("w7_stored_state", sql=arr_sql(f"""SELECT c.project_id, c.device_id, c.health_status, {iso('c.received_at')} AS updated_at, c.event_time < c.received_at - INTERVAL 3 HOUR AS offline_candidate,
    {_ledger_sql('s', 'device_status')}, {_ledger_sql('x', 'device_data')}, {_ledger_sql('t', 'device_settings')}, firmware_reset_count, startup_reset_count
  FROM cur c LEFT JOIN (SELECT * FROM stored WHERE ledger_name = 'device-status') s ON s.scope_value = c.device_id
    LEFT JOIN (SELECT * FROM stored WHERE ledger_name = 'device-data') x ON x.scope_value = c.device_id
    LEFT JOIN (SELECT * FROM stored WHERE ledger_name = 'device-settings') t ON t.scope_value = c.device_id
    LEFT JOIN (SELECT scope_value, arg_max(CAST(seq % 9 AS DOUBLE), (fetched_at, seq)) AS firmware_reset_count, arg_max(CAST(seq % 6 AS DOUBLE), (fetched_at, seq)) FILTER (seq % 5 = 0) AS startup_reset_count
      FROM acc WHERE effect = 'updated' AND ledger_name = 'device-status' AND seq % 3 <> 2 GROUP BY 1) r ON r.scope_value = c.device_id""", FOLD, FETCH))
def w7_stored(spark, sf_dir):
    fetched = accepted(spark, sf_dir)
    rows = state.stored_row(inputs.states(spark, sf_dir), ledgers.stored_snapshots(fetched), ledgers.reset_projection(fetched))
    ledger = [f"{p}_{f}" for p in ("device_status", "device_data", "device_settings") for f in ("updated_at", "fetched_at")]
    return rows.select(*state.KEY, "health_status", "updated_at", "offline_candidate", *ledger, "firmware_reset_count", "startup_reset_count")


CHANGES = """SELECT scope_value AS device_id, CASE ledger_name WHEN 'device-status' THEN 'RUNTIME' ELSE 'DATA' END AS kind, {time} AS time, ledger_name || CASE WHEN before IS NULL THEN ' snapshot available' ELSE ' snapshot updated' END AS summary
  FROM (SELECT scope_value, ledger_name, updated_at, lag(updated_at) OVER (PARTITION BY scope_value, ledger_name ORDER BY fetched_at, seq) AS before FROM acc WHERE effect = 'updated' AND ledger_name <> 'device-settings')"""


@query("t5_snapshot_changes", sql=plain(CHANGES.format(time=iso("updated_at")), FETCH))
def t5(spark, sf_dir):
    return ledgers.snapshot_changes(accepted(spark, sf_dir), fetch_slices(spark, sf_dir))


# ---- inventory and names

INV = f"""inv AS MATERIALIZED (SELECT c_custkey AS key, CAST(c_custkey AS VARCHAR) AS device_id, CASE WHEN c_custkey % 9 <> 8 THEN c_name END AS inventory_name,
    CASE WHEN c_custkey % 2 = 0 THEN '9' ELSE '{PRODUCT}' END AS inventory_product_id, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS connected,
    CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS os, CASE WHEN c_custkey % 4 <> 0 THEN {AS_OF} - to_minutes((c_custkey % 200) * 10) END AS last_heard, c_nationkey AS nk FROM customer)"""


@query("s7_inventory", sql=plain(f"SELECT device_id, inventory_name, inventory_product_id, connected, os AS device_os_inventory, {iso('last_heard')} AS last_heard FROM inv", INV))
def s7(spark, sf_dir):
    """Every device as a page of one of the three shapes, then normalized."""
    rows = inputs.inventory(spark, sf_dir)
    item = F.to_json(F.struct(*[c for c in INVENTORY_COLUMNS if c in rows.columns]))
    number = F.crc32("name") % 3
    page = F.when(number == 0, F.concat(F.lit("["), item, F.lit("]"))).when(
        number == 1, F.concat(F.lit('{"devices":['), item, F.lit("]}"))
    ).otherwise(F.concat(F.lit('{"meta":{"total_pages":1},"data":['), item, F.lit("]}")))
    return fleet.normalize_inventory(explode_pages(rows.select(page.alias("page"))), PRODUCT).drop("platform_id", "last_ip_address")


def devices(spark, sf_dir):
    return fleet.fleet_devices(inputs.inventory(spark, sf_dir), inputs.states(spark, sf_dir), PRODUCT)


DEV = "dev AS MATERIALIZED (SELECT i.*, coalesce(inventory_name, i.device_id) AS device_name, c.* EXCLUDE (device_id, device_name, k, n), c.device_id IS NOT NULL AS has_current_state FROM inv i LEFT JOIN cur c ON c.device_id = i.device_id)"


@query("j2_inventory_join", sql=arr_sql(f"SELECT device_id, device_name, inventory_product_id, has_current_state, CASE WHEN inventory_name IS NOT NULL THEN 'product-inventory' ELSE 'device-id' END AS name_source, health_status, {iso('event_time')} AS last_event_time FROM dev", FOLD, INV, DEV))
def j2(spark, sf_dir):
    return devices(spark, sf_dir).select("device_id", "device_name", "inventory_product_id", "has_current_state", "name_source", "health_status", "last_event_time")


def names(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "customer")
    return c.filter(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").cast("string").alias("device_id"), F.col("c_name").alias("device_name"))


@query("j3_device_names", sql=arr_sql("SELECT project_id, device_id, coalesce(CASE WHEN battery < 50 THEN NULL ELSE device_name END, c_name) AS device_name FROM cur LEFT JOIN customer ON c_custkey % 2 = 0 AND CAST(c_custkey AS VARCHAR) = device_id", FOLD))
def j3(spark, sf_dir):
    """Names of devices at low charge are taken away first, so that some have none."""
    rows = inputs.states(spark, sf_dir).withColumn("device_name", F.when(F.coalesce(F.col("battery") >= 50, F.lit(True)), F.col("device_name")))
    return state.with_names(rows, names(spark, sf_dir)).select(*state.KEY, "device_name")


@query("p27_canonical_name", sql=plain("SELECT device_id, coalesce(inventory_name, device_id) AS device_name FROM inv", INV))
def p27(spark, sf_dir):
    rows = fleet.normalize_inventory(inputs.inventory(spark, sf_dir), PRODUCT)
    return rows.select("device_id", fleet.canonical_name(F.col("inventory_name"), F.col("device_id")).alias("device_name"))


@query("l6_inventory_order", sql=arr_sql(f"SELECT device_id, device_name FROM dev ORDER BY coalesce(event_time, TIMESTAMP '1970-01-01 00:00:00') DESC, device_name, device_id", FOLD, INV, DEV))
def l6(spark, sf_dir):
    return fleet.inventory_order(devices(spark, sf_dir)).select("device_id", "device_name")


@query("q13_device_list", sql=arr_sql(f"SELECT device_id, device_name, event_type AS last_event_type, fw_version, {iso('event_time')} AS last_event_time FROM dev", FOLD, INV, DEV))
def q13(spark, sf_dir):
    return fleet.inventory_order(devices(spark, sf_dir)).select("device_id", "device_name", "last_event_type", "fw_version", "last_event_time")


def long_id(key):
    """24 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(key)), 24, "0")


def selectors(spark, sf_dir):
    """Full ids, exact names in other case, endings of names and ids (some ambiguous) and unknown words."""
    c = inputs.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    text = (
        F.when(key % 7 == 0, long_id(key)).when(key % 7 == 4, F.substr(long_id(key), F.lit(18))).when(key % 7 == 1, F.upper("c_name"))
        .when(key % 7 == 2, F.substr("c_name", F.length("c_name") - 4)).when(key % 7 == 3, F.concat(F.lit("nosuch"), key.cast("string")))
    )
    return c.select(text.alias("selector")).filter(F.col("selector").isNotNull())


@query("f9_device_selector", sql=plain("""SELECT selector, CASE WHEN m = 1 THEN device_id END AS device_id, m AS matches, CASE WHEN m > 1 THEN 'ambiguous' ELSE coalesce(match, 'none') END AS match
  FROM (SELECT s.selector, count(h.device_id) AS m, min(h.device_id) AS device_id, min(h.match) AS match FROM sel s LEFT JOIN hits h USING (selector) GROUP BY 1)""",
    "sel AS MATERIALIZED (SELECT DISTINCT selector FROM (SELECT CASE c_custkey % 7 WHEN 0 THEN lpad(lower(hex(c_custkey)), 24, '0') WHEN 4 THEN substr(lpad(lower(hex(c_custkey)), 24, '0'), 18) WHEN 1 THEN upper(c_name) WHEN 2 THEN substr(c_name, length(c_name) - 4) WHEN 3 THEN 'nosuch' || c_custkey END AS selector FROM customer) WHERE selector IS NOT NULL)",
    "nm AS MATERIALIZED (SELECT lpad(lower(hex(c_custkey)), 24, '0') AS device_id, lower(CASE WHEN c_custkey % 11 = 0 THEN lpad(lower(hex(c_custkey)), 24, '0') ELSE c_name END) AS name FROM customer)",
    "ids AS (SELECT selector, device_id, 'id' AS match FROM sel JOIN nm ON selector = device_id)",
    "exact AS (SELECT selector, device_id, 'exact' AS match FROM sel JOIN nm ON lower(selector) = name WHERE selector NOT IN (SELECT selector FROM ids))",
    "part AS (SELECT selector, device_id, 'partial' AS match FROM sel JOIN nm ON contains(name, lower(selector)) WHERE selector NOT IN (SELECT selector FROM ids) AND selector NOT IN (SELECT selector FROM exact))",
    "hits AS (SELECT * FROM ids UNION ALL SELECT * FROM exact UNION ALL SELECT * FROM part)"))
def f9(spark, sf_dir):
    key = F.col("c_custkey")
    c = inputs.table(spark, sf_dir, "customer").select(long_id(key).alias("device_id"), F.when(key % 11 != 0, F.col("c_name")).alias("device_name"))
    return filters.select_devices(c, selectors(spark, sf_dir))


# ---- fleet queries over current state

COUNTERS = f"""SELECT project_id, count(*) AS device_count, {', '.join(f"count(*) FILTER (health_status = '{s}') AS {s}" for s in filters.HEALTH_STATUSES)},
  count(*) FILTER (battery < 30) AS low_battery, count(*) FILTER (connect_time > 180) AS high_connect_time, count(*) FILTER (alert_count > 0) AS alerting,
  count(*) FILTER (plane = 'serial' AND severity = 'ERROR' AND event_time >= {AS_OF} - INTERVAL 24 HOUR) AS recent_serial_errors FROM cur"""


@query("q5_fleet_summary", sql=arr_sql(f"{COUNTERS} GROUP BY project_id", FOLD))
def q5(spark, sf_dir):
    return fleet.counters(inputs.states(spark, sf_dir), inputs.AS_OF)


@query("a9_fleet_counters", sql=arr_sql(f"{COUNTERS} WHERE health_status = 'critical' GROUP BY project_id", FOLD))
def a9(spark, sf_dir):
    return fleet.counters(inputs.states(spark, sf_dir), inputs.AS_OF, status="CRITICAL")


@query("f4_status_filter", sql=arr_sql("SELECT project_id, device_id FROM cur WHERE health_status = 'warning'", FOLD))
def f4(spark, sf_dir):
    return fleet.by_status(inputs.states(spark, sf_dir), "Warning").select(*state.KEY)


@query("f5_recent_and_offline", sql=arr_sql(f"""SELECT device_id, 'recent' AS kind FROM cur WHERE event_time >= {AS_OF} - INTERVAL 6 HOUR
  UNION ALL SELECT device_id, 'offline' FROM cur WHERE event_time < {AS_OF} - INTERVAL 6 HOUR""", FOLD))
def f5(spark, sf_dir):
    states = inputs.states(spark, sf_dir)
    recent = filters.recent(states, "last_event_time", 6, inputs.AS_OF).select("device_id", F.lit("recent").alias("kind"))
    return recent.unionByName(filters.offline(states, "last_event_time", 6, inputs.AS_OF).select("device_id", F.lit("offline").alias("kind")))


RISK = f"""SELECT project_id, device_id, health_status, {iso('event_time')} AS last_event_time, battery, array_to_string(types, ',') AS anomaly_types FROM cur
  WHERE (len(types) > 0 OR health_status IN ('warning', 'critical')) AND event_time >= {AS_OF} - INTERVAL 48 HOUR
  ORDER BY CASE health_status WHEN 'critical' THEN 4 WHEN 'warning' THEN 3 WHEN 'unknown' THEN 2 ELSE 1 END DESC, event_time DESC, project_id, device_id"""


def _risk(spark, sf_dir, limit):
    rows = fleet.at_risk(inputs.states(spark, sf_dir), inputs.AS_OF, 48, limit=limit)
    types = F.array_join(F.transform("anomalies", lambda a: a["type"]), ",")
    return rows.select(*state.KEY, "health_status", "last_event_time", "battery", types.alias("anomaly_types"))


@query("q6_fleet_anomalies", sql=arr_sql(RISK, FOLD))
def q6(spark, sf_dir):
    return _risk(spark, sf_dir, None)


@query("l3_fleet_risk_top", sql=arr_sql(RISK + " LIMIT 20", FOLD))
def l3(spark, sf_dir):
    return _risk(spark, sf_dir, 20)


OFFLINE = f"SELECT project_id, device_id, event_type AS last_event_type, plane AS last_plane, {iso('event_time')} AS last_event_time FROM cur WHERE event_time < {AS_OF} - INTERVAL 3 HOUR ORDER BY event_time, project_id, device_id"


def _offline(spark, sf_dir, limit):
    return fleet.offline_devices(inputs.states(spark, sf_dir), inputs.AS_OF, limit=limit).select(*state.KEY, "last_event_type", "last_plane", "last_event_time")


@query("q7_fleet_offline", sql=arr_sql(OFFLINE, FOLD))
def q7(spark, sf_dir):
    return _offline(spark, sf_dir, None)


@query("l4_offline_top", sql=arr_sql(OFFLINE + " LIMIT 15", FOLD))
def l4(spark, sf_dir):
    return _offline(spark, sf_dir, 15)


# ---- configuration and schedule

CONF = """conf AS MATERIALIZED (SELECT CAST(c_custkey AS VARCHAR) AS device_id,
    CASE c_custkey % 10 WHEN 0 THEN 1800.0 WHEN 5 THEN NULL ELSE CASE WHEN c_nationkey % 2 = 0 THEN 3600.0 ELSE 7200.0 END END::DOUBLE AS interval_s, 600.0::DOUBLE AS budget,
    CASE WHEN c_custkey % 10 = 5 THEN 20 ELSE 6 END AS open_hour, CASE WHEN c_custkey % 10 = 5 THEN 4 ELSE 22 END AS close_hour,
    CASE WHEN c_custkey % 10 = 3 THEN 'Mars/Olympus' ELSE (['America/New_York','UTC','Asia/Kolkata','EST5EDT,M3.2.0/2:00:00,M11.1.0/2:00:00'])[c_nationkey % 4 + 1] END AS zone,
    CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE (['America/New_York','UTC','Asia/Kolkata','America/New_York'])[c_nationkey % 4 + 1] END AS tz FROM customer)"""


def next_sql(last: str, interval: str, open_: str, close: str, tz: str) -> str:
    """Next report in SQL; ``tz`` is a zone name the engine knows, null when invalid."""
    cand = f"({last} + to_microseconds(CAST({interval} AS BIGINT) * 1000000))"
    local = f"timezone({tz}, timezone('UTC', {cand}))"
    sec = f"(hour({local}) * 3600 + minute({local}) * 60 + second({local}))"
    day = f"(CAST({local} AS DATE) + CASE WHEN {open_} > {close} OR {sec} < {open_} * 3600 THEN 0 ELSE 1 END)"
    inside = f"CASE WHEN {open_} = {close} THEN true WHEN {open_} < {close} THEN {sec} BETWEEN {open_} * 3600 AND {close} * 3600 ELSE {sec} >= {open_} * 3600 OR {sec} <= {close} * 3600 END"
    return f"CASE WHEN {tz} IS NULL THEN NULL WHEN {inside} THEN {cand} ELSE timezone('UTC', timezone({tz}, CAST({day} AS TIMESTAMP) + to_hours({open_}))) END"


@query("j8_effective_configuration", sql=plain("SELECT device_id, interval_s AS reporting_interval_seconds, budget AS connection_budget_seconds, CAST(open_hour AS BIGINT) AS open_hour, CAST(close_hour AS BIGINT) AS close_hour, zone AS time_zone FROM conf", CONF))
def j8(spark, sf_dir):
    rows = fleet.with_configuration(inputs.configuration(spark, sf_dir))
    return rows.select("device_id", "reporting_interval_seconds", "connection_budget_seconds", F.col("open_hour").cast("bigint").alias("open_hour"), F.col("close_hour").cast("bigint").alias("close_hour"), "time_zone")


OVERLAY = """docs AS (SELECT CAST(c_custkey AS VARCHAR) AS device_id, '{"timing":{"reportingIntervalSec":' || CASE WHEN c_nationkey % 2 = 0 THEN 3600 ELSE 7200 END || ',"window":{"open":6,"close":22,"days":["mon","tue"]}},"radio":{"bands":[' || c_nationkey || '],"power":null,"apn":{}},"label":"n' || c_nationkey || '"}' AS defaults,
    CASE c_custkey % 8 WHEN 1 THEN '{"timing":{"reportingIntervalSec":null,"window":{"open":8}}}' WHEN 2 THEN '{"timing":5,"extra":{"deep":{"deeper":{"x":' || c_custkey || '}}}}'
      WHEN 3 THEN '{"radio":{"apn":{"name":"iot"},"power":{"tx":3}},"label":{"text":"a","lang":"en"}}' WHEN 4 THEN '{"timing":{},"radio":{"apn":{},"bands":{}},"label":{}}'
      WHEN 6 THEN '[1,2]' WHEN 7 THEN '{"timing":{"window":null},"unknown":[{"a":1}]}' END AS settings FROM customer),
  dl AS MATERIALIZED (SELECT device_id, substr(t.fullkey, 3) AS path, CASE WHEN t.type = 'NULL' THEN 'null' ELSE CAST(json(t.value) AS VARCHAR) END AS value FROM docs, json_tree(CAST(defaults AS JSON)) t
    WHERE t.fullkey <> '$' AND NOT contains(t.fullkey, '[') AND (t.type <> 'OBJECT' OR CAST(json(t.value) AS VARCHAR) = '{}')),
  ol AS MATERIALIZED (SELECT device_id, substr(t.fullkey, 3) AS path, CASE WHEN t.type = 'NULL' THEN 'null' ELSE CAST(json(t.value) AS VARCHAR) END AS value FROM (SELECT * FROM docs WHERE settings LIKE '{%'), json_tree(CAST(settings AS JSON)) t
    WHERE t.fullkey <> '$' AND NOT contains(t.fullkey, '[') AND (t.type <> 'OBJECT' OR CAST(json(t.value) AS VARCHAR) = '{}'))"""


@query("j8_overlay_any_path", sql=plain("""SELECT device_id, path, value, 'default' AS source FROM dl WHERE NOT EXISTS (SELECT 1 FROM ol WHERE ol.device_id = dl.device_id
      AND ((ol.value <> '{}' AND (dl.path = ol.path OR starts_with(dl.path, ol.path || '.'))) OR starts_with(ol.path, dl.path || '.') OR (ol.value = '{}' AND ol.path = dl.path)))
    UNION ALL SELECT device_id, path, value, 'override' FROM ol WHERE NOT (value = '{}' AND EXISTS (SELECT 1 FROM dl WHERE dl.device_id = ol.device_id AND starts_with(dl.path, ol.path || '.')))""", OVERLAY))
def j8_overlay(spark, sf_dir):
    """Nested documents with keys that no fixed path names: effective values by path."""
    c = inputs.dealt(inputs.table(spark, sf_dir, "customer"), "c_custkey")
    key, nk = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    interval = F.when(F.col("c_nationkey") % 2 == 0, "3600").otherwise("7200")
    defaults = F.concat(F.lit('{"timing":{"reportingIntervalSec":'), interval, F.lit(',"window":{"open":6,"close":22,"days":["mon","tue"]}},"radio":{"bands":['), nk, F.lit('],"power":null,"apn":{}},"label":"n'), nk, F.lit('"}'))
    settings = (
        F.when(key % 8 == 1, '{"timing":{"reportingIntervalSec":null,"window":{"open":8}}}')
        .when(key % 8 == 2, F.concat(F.lit('{"timing":5,"extra":{"deep":{"deeper":{"x":'), key.cast("string"), F.lit("}}}}")))
        .when(key % 8 == 3, '{"radio":{"apn":{"name":"iot"},"power":{"tx":3}},"label":{"text":"a","lang":"en"}}')
        .when(key % 8 == 4, '{"timing":{},"radio":{"apn":{},"bands":{}},"label":{}}').when(key % 8 == 5, "not json")
        .when(key % 8 == 6, "[1,2]").when(key % 8 == 7, '{"timing":{"window":null},"unknown":[{"a":1}]}')
    )
    docs = c.select(key.cast("string").alias("device_id"), defaults.alias("defaults"), settings.alias("settings"))
    merged = overlay.overlaid(overlay.leaves(docs, "device_id", "defaults"), overlay.leaves(docs, "device_id", "settings"), "device_id")
    return merged.select("device_id", F.array_join("path", ".").alias("path"), "value", "source")


ZONES = ["America/New_York", "UTC", "Asia/Kolkata", inputs.POSIX_EASTERN, "Australia/Sydney", "Nowhere/None", ""]


def schedule_cases(spark, sf_dir):
    """Events spread over a year, with hours and zones by event number."""
    e = inputs.table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("seq"),
        F.timestamp_micros(F.unix_micros(F.date_trunc("second", F.col("ts").cast("timestamp"))) + (n * 7919 % 31_000_000) * 1_000_000).alias("last"),
        F.when(n % 5 == 0, F.lit(7200.0)).otherwise(F.lit(3600.0)).alias("interval"),
        F.when(n % 4 == 0, 20).when(n % 4 == 1, 2).otherwise(6).alias("opens"),
        F.when(n % 4 == 0, 4).when(n % 4 == 3, 6).otherwise(22).alias("closes"),
        F.element_at(F.array(*map(F.lit, ZONES)), (n % 7 + 1).cast("int")).alias("zone"),
    )


CASES = """cases AS MATERIALIZED (SELECT event_id AS seq, date_trunc('second', ts) + to_seconds(event_id * 7919 % 31000000) AS last, CASE WHEN event_id % 5 = 0 THEN 7200 ELSE 3600 END AS i,
    CASE event_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 2 ELSE 6 END AS o, CASE event_id % 4 WHEN 0 THEN 4 WHEN 3 THEN 6 ELSE 22 END AS c,
    (['America/New_York','UTC','Asia/Kolkata','America/New_York','Australia/Sydney',NULL,'none'])[event_id % 7 + 1] AS tz FROM events)"""


@query("r10_next_report", sql=plain(f"SELECT seq, {iso('CASE WHEN tz = ' + chr(39) + 'none' + chr(39) + ' THEN last + to_seconds(i) ELSE nxt END')} AS next_scheduled_report FROM (SELECT *, {next_sql('last', 'i', 'o', 'c', 'nullif(tz, ' + chr(39) + 'none' + chr(39) + ')')} AS nxt FROM cases)", CASES))
def r10(spark, sf_dir):
    rows = schedule.next_report(schedule_cases(spark, sf_dir), "last", "interval", "opens", "closes", "zone")
    return rows.select("seq", "next_scheduled_report")


POSIX_ZONES = [inputs.POSIX_EASTERN, "CET-1CEST,M3.5.0,M10.5.0/3", "UTC0", "AEST-10AEDT,M10.1.0,M4.1.0/3"]
POSIX_OFFSETS = "SELECT seq, epoch(timezone(z, timezone('UTC', last)) - last)::BIGINT AS offset_seconds FROM (SELECT *, (['America/New_York','Europe/Berlin','UTC','Australia/Sydney'])[seq % 4 + 1] AS z FROM cases)"


def posix_cases(spark, sf_dir):
    zone = F.element_at(F.array(*map(F.lit, POSIX_ZONES)), (F.col("seq") % 4 + 1).cast("int"))
    return schedule_cases(spark, sf_dir).select("seq", "last", zone.alias("zone"))


@query("j10_posix_transitions", sql=plain(POSIX_OFFSETS, CASES))
def j10(spark, sf_dir):
    """Offset of every instant from the ranges of each distinct zone, over the years that occur."""
    cases = posix_cases(spark, sf_dir).withColumns({"year": F.year("last"), "second": F.unix_seconds("last")})
    first, last = cases.agg(F.min("year"), F.max("year")).first()
    zones = schedule.zone_rules(cases.select("zone").distinct(), "zone")
    ranges = schedule.offset_ranges(zones, first or 1970, last or 1970).select("zone", "year", "begin", "end", "offset")
    at = cases.join(ranges, ["zone", "year"]).where((F.col("second") >= F.col("begin")) & (F.col("second") < F.col("end")))
    return at.select("seq", F.col("offset").cast("bigint").alias("offset_seconds"))


@query("j10_posix_offsets", sql=plain(POSIX_OFFSETS, CASES))
def j10_offsets(spark, sf_dir):
    """The same offsets from the ranges around each instant, without a join."""
    ruled = schedule.zone_rules(posix_cases(spark, sf_dir), "zone").withColumn("second", F.unix_seconds("last"))
    ruled = ruled.withColumn("ranges", schedule.ranges_around(F.col("second"), F.col("posix")))
    return ruled.select("seq", schedule.offset_at(F.col("second"), F.col("ranges")).cast("bigint").alias("offset_seconds"))


@query("r11_relative_age", sql=arr_sql(f"""SELECT event_id, CASE WHEN s < 60 THEN s || ' sec' WHEN s < 3600 THEN s // 60 || ' min' WHEN s < 172800 THEN s // 3600 || ' hr' WHEN s // 86400 = 1 THEN '1 day' ELSE s // 86400 || ' days' END AS age
  FROM (SELECT event_id, greatest(0, epoch_ms({AS_OF} - event_time) // 1000) AS s FROM arr)"""))
def r11(spark, sf_dir):
    return inputs.arrivals(spark, sf_dir).select("event_id", age_text(F.col("event_time"), F.lit(inputs.AS_OF).cast("timestamp")).alias("age"))


# ---- fleet report

REP = f"""rep AS MATERIALIZED (SELECT *, CASE WHEN expected IS NULL THEN 'unknown' WHEN {AS_OF} > expected THEN 'overdue' ELSE 'upcoming' END AS expectation_status FROM (
    SELECT *, nxt + to_seconds(660) AS expected FROM (
      SELECT d.*, coalesce(d.fw_version, CASE WHEN s.seq IS NOT NULL THEN 'fw-' || (s.seq % 4) END) AS firmware_version, d.os AS device_os_version,
        CASE WHEN s.seq IS NULL THEN NULL WHEN s.seq % 2 = 0 THEN 'connected' ELSE 'disconnected' END AS runtime_state,
        coalesce(d.connected, s.seq % 2 = 0) AS is_connected, s.seq IS NOT NULL AS has_runtime_status, x.seq IS NOT NULL AS has_device_data,
        CASE WHEN s.soc <= 100 THEN CAST(s.soc AS DOUBLE) WHEN d.battery BETWEEN 0 AND 100 THEN d.battery END AS soc_percent,
        CASE WHEN s.soc <= 100 THEN 'device-status' WHEN d.battery BETWEEN 0 AND 100 THEN 'telemetry' END AS soc_source,
        CASE WHEN s.soc <= 100 THEN s.updated_at WHEN d.battery BETWEEN 0 AND 100 THEN d.event_time END AS soc_observed_at,
        f.interval_s, CASE WHEN d.last_application_report_at IS NOT NULL AND f.interval_s IS NOT NULL THEN {next_sql('d.last_application_report_at', 'f.interval_s', 'f.open_hour', 'f.close_hour', 'f.tz')} END AS nxt
      FROM dev d LEFT JOIN (SELECT * FROM stored WHERE ledger_name = 'device-status') s ON s.scope_value = d.device_id LEFT JOIN (SELECT * FROM stored WHERE ledger_name = 'device-data') x ON x.scope_value = d.device_id JOIN conf f ON f.device_id = d.device_id)))"""
REPORT = (FOLD, INV, DEV, FETCH, CONF, REP)


def report(spark, sf_dir):
    snapshots = ledgers.stored_snapshots(accepted(spark, sf_dir))
    rows = fleet.with_ledgers(devices(spark, sf_dir), snapshots, inputs.configuration(spark, sf_dir))
    return fleet.report_rows(rows, inputs.AS_OF)


@query("p26_device_facts", sql=arr_sql(f"SELECT device_id, firmware_version, device_os_version, runtime_state AS runtime_connection_state, is_connected, soc_percent, soc_source, {iso('soc_observed_at')} AS soc_observed_at FROM rep", *REPORT))
def p26(spark, sf_dir):
    return report(spark, sf_dir).select("device_id", "firmware_version", "device_os_version", "runtime_connection_state", "is_connected", "soc_percent", "soc_source", "soc_observed_at")


@query("r9_reporting_expectation", sql=arr_sql(f"SELECT device_id, {iso('last_application_report_at')} AS last_application_report_at, interval_s AS reporting_interval_seconds, {iso('nxt')} AS next_scheduled_report, {iso('expected')} AS expected_next_report, expectation_status FROM rep", *REPORT))
def r9(spark, sf_dir):
    return report(spark, sf_dir).select("device_id", "last_application_report_at", "reporting_interval_seconds", "next_scheduled_report", "expected_next_report", "expectation_status")


@query("a10_coverage", sql=arr_sql("""SELECT count(*) AS inventory, count(*) FILTER (has_current_state) AS current_state, count(*) FILTER (has_runtime_status) AS runtime_status, count(*) FILTER (has_device_data) AS device_data,
  count(*) FILTER (is_connected) AS connected, count(*) FILTER (NOT is_connected) AS disconnected, count(*) FILTER (is_connected IS NULL) AS unknown FROM rep""", *REPORT))
def a10(spark, sf_dir):
    return fleet.coverage(report(spark, sf_dir))


@query("a11_firmware_distribution", sql=arr_sql("SELECT coalesce(firmware_version, '<unknown>') AS value, count(*) AS count FROM rep GROUP BY 1", *REPORT))
def a11(spark, sf_dir):
    return fleet.distribution(report(spark, sf_dir), "firmware_version")


@query("a11_os_distribution", sql=arr_sql("SELECT coalesce(device_os_version, '<unknown>') AS value, count(*) AS count FROM rep GROUP BY 1", *REPORT))
def a11_os(spark, sf_dir):
    return fleet.distribution(report(spark, sf_dir), "device_os_version")


@query("a12_charge_overview", sql=arr_sql("SELECT count(soc_percent) AS observed, count(*) AS inventory, count(*) - count(soc_percent) AS unknown, min(soc_percent) AS lowest, median(soc_percent) AS median FROM rep", *REPORT))
def a12(spark, sf_dir):
    return fleet.charge_overview(report(spark, sf_dir))


def _age(x: str, long: bool = False) -> str:
    s = f"greatest(0, epoch_ms({AS_OF} - {x}) // 1000)"
    return (f"CASE WHEN {x} IS NULL THEN 'unknown' WHEN {s} < 60 THEN {s} || ' sec' WHEN {s} < 3600 THEN {s} // 60 || ' {'minutes' if long else 'min'}' "
            f"WHEN {s} < 172800 THEN {s} // 3600 || ' {'hours' if long else 'hr'}' WHEN {s} // 86400 = 1 THEN '1 day' ELSE {s} // 86400 || ' days' END")


ATTENTION = f"""obs AS MATERIALIZED (SELECT device_id, device_name, [x FOR x IN [
    CASE WHEN waiting THEN 'Cloud connected' END, CASE WHEN waiting THEN 'Waiting for first telemetry' END,
    CASE WHEN NOT waiting AND NOT has_current_state THEN 'No Current State' END,
    CASE WHEN NOT waiting AND (NOT has_current_state OR NOT has_runtime_status) THEN 'Last heard ' || {_age('coalesce(last_heard, event_time)', True)} || ' ago' END,
    CASE WHEN NOT waiting AND NOT has_runtime_status THEN 'Runtime status not yet observed' END,
    CASE WHEN NOT has_device_data THEN 'Device Data not observed' END,
    CASE WHEN soc_percent IS NOT NULL AND {AS_OF} - soc_observed_at >= INTERVAL 6 HOUR THEN 'Last reported SOC ' || CAST(floor(soc_percent + 0.5) AS BIGINT) || '%' END,
    CASE WHEN soc_percent IS NOT NULL AND {AS_OF} - soc_observed_at >= INTERVAL 6 HOUR THEN 'SOC observation is ' || {_age('soc_observed_at')} || ' old' END,
    CASE WHEN event_type = 'serial.log' AND event_time > last_heard + INTERVAL 5 MINUTE AND event_time >= {AS_OF} - INTERVAL 1 HOUR THEN 'Recent serial activity; cloud last heard ' || {_age('last_heard')} || ' ago' END,
    CASE WHEN expectation_status = 'overdue' THEN 'Expected application report ' || {_age('expected', True)} || ' ago' END] IF x IS NOT NULL] AS lines
  FROM (SELECT *, coalesce(is_connected, false) AND NOT has_current_state AND NOT has_runtime_status AS waiting FROM rep))"""


@query("r8_attention", sql=arr_sql("SELECT device_id, device_name, CAST(i - 1 AS BIGINT) AS position, lines[i] AS observation FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM obs)", *REPORT, ATTENTION))
def r8(spark, sf_dir):
    rows = fleet.attention(report(spark, sf_dir), inputs.AS_OF, device_data_enabled=True)
    return rows.withColumn("position", F.col("position").cast("bigint"))


ACTIVITY = f"""act AS MATERIALIZED (SELECT device_id, device_name, coalesce(event_time, last_heard) AS time,
    CASE WHEN event_time IS NULL THEN 'EVENT' WHEN event_type = 'fault.watchdog' THEN 'WATCHDOG' WHEN event_type = 'serial.log' THEN 'SERIAL' WHEN event_type = 'telemetry.status' THEN 'LIFECYCLE' ELSE 'TELEMETRY' END AS kind,
    CASE WHEN event_time IS NULL THEN 'Connected to cloud' WHEN event_type = 'fault.watchdog' THEN 'Fault Watchdog' WHEN event_type = 'serial.log' THEN 'Serial log event' WHEN event_type = 'telemetry.status' THEN 'Device status event'
      WHEN event_type = 'telemetry.occupancy' THEN 'Occupancy report' WHEN event_type = 'telemetry.health' THEN 'Telemetry health report' ELSE 'Telemetry Event' END AS summary,
    CASE WHEN event_time IS NULL THEN 'product-inventory' ELSE 'current-state' END AS source
  FROM rep WHERE (event_time IS NULL AND is_connected AND last_heard IS NOT NULL) OR (event_time IS NOT NULL AND NOT starts_with(event_type, 'serial.lifecycle')))"""


@query("l5_recent_activity", sql=arr_sql(f"SELECT device_id, device_name, {iso('time')} AS time, kind, summary, source FROM act", *REPORT, ACTIVITY))
def l5(spark, sf_dir):
    return fleet.recent_activity(report(spark, sf_dir), None)


@query("l5_recent_activity_top", sql=arr_sql(f"SELECT device_id, device_name, {iso('time')} AS time, kind, summary, source FROM act ORDER BY act.time DESC, device_name, device_id LIMIT 10", *REPORT, ACTIVITY))
def l5_top(spark, sf_dir):
    return fleet.recent_activity(report(spark, sf_dir))


@query("q11_fleet_report", sql=arr_sql(f"""SELECT device_id, device_name, inventory_product_id AS product_id, is_connected, firmware_version, device_os_version, soc_percent, expectation_status,
  has_current_state, has_runtime_status, {iso('event_time')} AS last_event_time, {iso('last_heard')} AS last_heard, {iso('expected')} AS expected_next_report FROM rep""", *REPORT))
def q11(spark, sf_dir):
    return report(spark, sf_dir).select(
        "device_id", "device_name", F.col("inventory_product_id").alias("product_id"), "is_connected", "firmware_version", "device_os_version", "soc_percent",
        "expectation_status", "has_current_state", "has_runtime_status", "last_event_time", "last_heard", "expected_next_report",
    )
