"""Fleet views: counters, risk order, inventory join, report rows, attention and recent activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlake.functions.values import age_text, blank_to_null, micros_between
from fleetlake.operators.filters import HEALTH_STATUSES, health_status, offline, recent
from fleetlake.operators.ledgers import is_object, json_at, json_number, json_text
from fleetlake.operators.presentation import present
from fleetlake.operators.schedule import next_report, zone_rules

RISK = {"critical": 4, "warning": 3, "unknown": 2, "healthy": 1}
TRANSPORT_ALLOWANCE_SECONDS = 60
ACTIVITY_LIMIT = 10
# Configuration paths in the order they are tried.
INTERVAL_PATHS = [("timing", "reportingIntervalSec"), ("reporting", "intervalSeconds"), ("reporting", "intervalSec")]
INTERVAL_MINUTE_PATHS = [("reporting", "intervalMinutes")]
BUDGET_PATHS = [
    ("timing", "connectAttemptBudgetSec"), ("connection", "connectAttemptBudgetSec"),
    ("connection", "budgetSeconds"), ("reporting", "connectionBudgetSeconds"),
]


def by_status(states: DataFrame, status: str | None) -> DataFrame:
    wanted = health_status(status)
    return states.filter(F.col("health_status") == wanted) if wanted else states


def counters(states: DataFrame, as_of: str, hours: float = 24, status: str | None = None) -> DataFrame:
    """Health, battery, connection, alert and serial-error counts per project."""
    rows = by_status(states, status)
    since = F.unix_micros(F.lit(as_of).cast("timestamp")) - int(hours * 3_600_000_000)
    serial_error = (F.col("last_plane") == "serial") & (F.col("severity") == "ERROR") & (F.unix_micros("last_event_time") >= since)
    return rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("device_count"),
        *[F.count_if(F.col("health_status") == s).alias(s) for s in HEALTH_STATUSES],
        F.count_if(F.col("battery") < 30).alias("low_battery"),
        F.count_if(F.col("connect_time") > 180).alias("high_connect_time"),
        F.count_if(F.col("alert_count") > 0).alias("alerting"),
        F.count_if(serial_error).alias("recent_serial_errors"),
    )


def at_risk(states: DataFrame, as_of: str, hours: float = 24, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Recently seen devices with anomalies or a bad status, worst first, then newest."""
    rows = by_status(states, status).filter((F.col("anomaly_count") > 0) | F.col("health_status").isin("warning", "critical"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RISK.items() for x in kv]), F.col("health_status"))
    rows = recent(rows, "last_event_time", hours, as_of).orderBy(rank.desc(), F.col("last_event_time").desc(), "project_id", "device_id")
    return rows.limit(limit) if limit else rows


def offline_devices(states: DataFrame, as_of: str, hours: float = 3, limit: int | None = None) -> DataFrame:
    """Devices not heard of for more than ``hours``, oldest first."""
    rows = offline(states, "last_event_time", hours, as_of).orderBy("last_event_time", "project_id", "device_id")
    return rows.limit(limit) if limit else rows


def normalize_inventory(rows: DataFrame, product_id: str) -> DataFrame:
    """Inventory rows with id, name and product fallbacks; rows without an id are dropped."""
    def first(*columns: str) -> Column:
        found = [F.col(c) if c in ("last_heard", "lastHeard") else blank_to_null(F.col(c)) for c in columns if c in rows.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return rows.select(
        first("id", "device_id", "deviceId").alias("device_id"),
        first("name").alias("inventory_name"),
        F.coalesce(first("product_id", "productId"), F.lit(product_id)).alias("inventory_product_id"),
        "connected",
        first("system_firmware_version", "systemFirmwareVersion", "firmware_version", "firmwareVersion").alias("device_os_inventory"),
        first("last_heard", "lastHeard").alias("last_heard"),
        first("platform_id", "platformId").alias("platform_id"),
        first("last_ip_address", "lastIpAddress").alias("last_ip_address"),
    ).filter(F.col("device_id").isNotNull())


def canonical_name(*names: Column) -> Column:
    """First non-blank name."""
    return F.coalesce(*[blank_to_null(n) for n in names], F.lit("<unknown>"))


def fleet_devices(inventory: DataFrame, states: DataFrame, product_id: str) -> DataFrame:
    """Inventory decides membership; the current state is attached where there is one (one state per device)."""
    attached = states.withColumn("has_current_state", F.lit(True)).withColumnRenamed("device_name", "state_name")
    joined = normalize_inventory(inventory, product_id).join(attached, "device_id", "left")
    name = canonical_name(F.col("inventory_name"), F.col("device_id"))
    return joined.withColumns({
        "device_name": name,
        "name_source": F.when(name == F.col("inventory_name"), "product-inventory").otherwise("device-id"),
        "has_inventory": F.lit(True),
        "has_current_state": F.coalesce("has_current_state", F.lit(False)),
    }).drop("inventory_name")


def inventory_order(devices: DataFrame) -> DataFrame:
    """Latest event first, then name and id."""
    return devices.orderBy(F.coalesce("last_event_time", F.timestamp_seconds(F.lit(0))).desc(), "device_name", "device_id")


def with_ledgers(devices: DataFrame, snapshots: DataFrame, configuration: DataFrame) -> DataFrame:
    """Attach the status snapshot, when the data snapshot was updated, and what the two configuration documents say."""
    status = snapshots.filter(F.col("ledger_name") == "device-status").select(
        F.col("scope_value").alias("device_id"), F.col("updated_at").alias("status_updated_at"),
        F.col("fetched_at").alias("status_fetched_at"), F.col("data").alias("status_data"),
    )
    data = snapshots.filter((F.col("ledger_name") == "device-data") & F.coalesce("updated_at", "fetched_at").isNotNull()).select(
        F.col("scope_value").alias("device_id"), F.coalesce("updated_at", "fetched_at").alias("device_data_updated_at"))
    # Devices share configurations: each distinct pair of documents is read, and its zone resolved, once.
    documents = ["product_defaults", "device_settings"]
    read = zone_rules(with_configuration(configuration.select(*documents).distinct()), "time_zone").withColumnsRenamed({d: f"_{d}" for d in documents})
    same = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in documents]
    resolved = configuration.join(read, same, "left").drop(*[f"_{d}" for d in documents])
    return devices.join(status, "device_id", "left").join(data, "device_id", "left").join(resolved, "device_id", "left")


def with_configuration(devices: DataFrame) -> DataFrame:
    """Reporting interval, connection budget, hours and zone from defaults overlaid with device settings.

    An override key wins even when null; objects are merged key by key. What the documents hold is fetched first and read then, so that
    no expression holds another twice.
    """
    hours, zone = {"open_hour": ("timing", "openHour"), "close_hour": ("timing", "closeHour")}, ("timing", "timezone")
    numbers = [*INTERVAL_PATHS, *INTERVAL_MINUTE_PATHS, *BUDGET_PATHS, *hours.values()]
    name = {p: f"_{p[0]}_{p[1]}" for p in [*numbers, zone]}
    groups = sorted({p[0] for p in name})
    parsed = devices.withColumns({"_defaults": F.try_parse_json("product_defaults"), "_settings": F.try_parse_json("device_settings")})
    fetched = parsed.withColumns({
        **{f"{n}_own": json_at(F.col("_settings"), ".".join(p)) for p, n in name.items()}, **{f"{n}_default": json_at(F.col("_defaults"), ".".join(p)) for p, n in name.items()},
        **{f"_group_{g}": json_at(F.col("_settings"), g) for g in groups},
    })
    replaced = fetched.withColumns({f"_replaced_{g}": F.col(f"_group_{g}").isNotNull() & ~is_object(F.col(f"_group_{g}")) for g in groups})

    def effective(p: tuple[str, str], read) -> Column:
        own, default = F.col(f"{name[p]}_own"), F.col(f"{name[p]}_default")
        return F.when(own.isNotNull(), read(own)).when(~F.col(f"_replaced_{p[0]}"), read(default))

    values = replaced.withColumns({name[p]: effective(p, json_number) for p in numbers} | {name[zone]: effective(zone, json_text)})

    def first(paths: list[tuple[str, str]]) -> Column:
        return F.coalesce(*[F.when(F.col(name[p]) >= 0, F.col(name[p])) for p in paths])

    def hour(p: tuple[str, str]) -> Column:
        h = F.col(name[p])
        return F.when((h >= 0) & (h == F.floor(h)) & (h <= 23), h.cast("int"))

    done = values.withColumns({
        "reporting_interval_seconds": F.coalesce(first(INTERVAL_PATHS), first(INTERVAL_MINUTE_PATHS) * 60), "connection_budget_seconds": first(BUDGET_PATHS),
        **{h: hour(p) for h, p in hours.items()}, "time_zone": F.col(name[zone]),
    })
    return done.drop("_defaults", "_settings", *[f"{n}{end}" for n in name.values() for end in ("", "_own", "_default")], *[f"_{kind}_{g}" for g in groups for kind in ("group", "replaced")])


def reporting_expectation(devices: DataFrame, as_of: str, allowance: float = TRANSPORT_ALLOWANCE_SECONDS) -> DataFrame:
    """Next and expected report of every device, and whether it is overdue."""
    devices = devices if "reporting_interval_seconds" in devices.columns else with_configuration(devices)
    last = F.coalesce("last_application_report_at", F.when(F.col("last_plane") == "telemetry", F.col("last_event_time")))
    reported = next_report(
        devices.withColumn("last_application_report_at", last),
        "last_application_report_at", "reporting_interval_seconds", "open_hour", "close_hour", "time_zone",
    )
    complete = F.col("last_application_report_at").isNotNull() & F.col("reporting_interval_seconds").isNotNull() & F.col("connection_budget_seconds").isNotNull()
    extra = ((F.col("connection_budget_seconds") + F.lit(float(allowance))) * 1_000_000).cast("bigint")
    return reported.withColumn("next_scheduled_report", F.when(complete, F.col("next_scheduled_report"))).withColumn(
        "expected_next_report", F.timestamp_micros(F.unix_micros("next_scheduled_report") + extra)
    ).withColumn(
        "expectation_status",
        F.when(F.col("expected_next_report").isNull(), "unknown")
        .when(F.lit(as_of).cast("timestamp") > F.col("expected_next_report"), "overdue").otherwise("upcoming"),
    )


def device_facts(devices: DataFrame) -> DataFrame:
    """Firmware, OS, connection and state of charge, each from the first source that has it."""
    d = devices.withColumn("_status", F.try_parse_json("status_data"))

    def text(path: str) -> Column:
        return json_text(json_at(F.col("_status"), path))

    def charge(n: Column) -> Column:
        return F.when(n.between(0, 100), n)

    runtime = text("connection.state")
    ledger_soc, state_soc = charge(json_number(json_at(F.col("_status"), "battery.soc"))), charge(F.col("battery"))
    return d.withColumns({
        "firmware_version": F.coalesce(blank_to_null(F.col("fw_version")), text("firmware.version"), text("application.version")),
        "device_os_version": F.coalesce(
            F.col("device_os_inventory"), text("system.firmwareVersion"), text("deviceOS.version"), text("startup.deviceOS")),
        "runtime_connection_state": runtime,
        "schema_version": F.try_variant_get("_status", "$.schemaVersion", "string"),
        "is_connected": F.coalesce("connected", F.when(F.lower(runtime) == "connected", True).when(F.lower(runtime) == "disconnected", False)),
        "soc_percent": F.coalesce(ledger_soc, state_soc),
        "soc_source": F.when(ledger_soc.isNotNull(), "device-status").when(state_soc.isNotNull(), "telemetry"),
        "soc_observed_at": F.when(ledger_soc.isNotNull(), F.col("status_updated_at")).when(state_soc.isNotNull(), F.col("last_event_time")),
        "has_runtime_status": F.coalesce(F.col("status_data"), F.col("status_updated_at").cast("string"), F.col("status_fetched_at").cast("string")).isNotNull(),
        "has_device_data": F.lit(False) if "device_data_updated_at" not in devices.columns else F.col("device_data_updated_at").isNotNull(),
    }).drop("_status")


def report_rows(devices: DataFrame, as_of: str, allowance: float = TRANSPORT_ALLOWANCE_SECONDS) -> DataFrame:
    """The per-device row of the fleet report."""
    return reporting_expectation(device_facts(devices), as_of, allowance)


def coverage(rows: DataFrame) -> DataFrame:
    """Coverage and connection counts of the whole fleet in one pass."""
    c = F.col("is_connected")
    return rows.agg(
        F.count_if("has_inventory").alias("inventory"), F.count_if("has_current_state").alias("current_state"),
        F.count_if("has_runtime_status").alias("runtime_status"), F.count_if("has_device_data").alias("device_data"),
        F.count_if(c).alias("connected"), F.count_if(~c).alias("disconnected"), F.count_if(c.isNull()).alias("unknown"),
    )


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Counts per value, largest first, ``<unknown>`` last."""
    value = F.coalesce(blank_to_null(F.col(column)), F.lit("<unknown>"))
    counted = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy((F.col("value") == "<unknown>").cast("int"), F.col("count").desc(), "value")


def charge_overview(rows: DataFrame) -> DataFrame:
    """Observed and unknown devices, lowest and exact median state of charge.

    The median counts devices per value first, so the exact percentile sees one row per distinct value.
    """
    per_value = rows.groupBy("soc_percent").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_inventory").alias("members"))
    observed = F.coalesce(F.sum(F.when(F.col("soc_percent").isNotNull(), F.col("n"))), F.lit(0))
    return per_value.agg(
        observed.alias("observed"), F.sum("members").alias("inventory"),
        F.greatest(F.lit(0), F.sum("members") - observed).alias("unknown"),
        F.min("soc_percent").alias("lowest"),
        F.expr("percentile(soc_percent, 0.5, n)").alias("median"),
    )


def attention(rows: DataFrame, as_of: str, device_data_enabled: bool = False) -> DataFrame:
    """One row per observation, in display order."""
    now = F.lit(as_of).cast("timestamp")
    waiting = F.col("has_inventory") & F.coalesce(F.col("is_connected"), F.lit(False)) & ~F.col("has_current_state") & ~F.col("has_runtime_status")
    no_state, no_status = ~waiting & ~F.col("has_current_state"), ~waiting & ~F.col("has_runtime_status")
    heard = F.coalesce("last_heard", "last_event_time")
    old_charge = F.col("soc_percent").isNotNull() & (micros_between(F.col("soc_observed_at"), now) >= 6 * 3_600_000_000)
    serial = (
        (F.col("last_event_type") == "serial.log")
        & (micros_between(F.col("last_heard"), F.col("last_event_time")) > 300_000_000)
        & (micros_between(F.col("last_event_time"), now) <= 3_600_000_000)
    )
    overdue = (F.col("expectation_status") == "overdue") & F.col("expected_next_report").isNotNull()
    soc = F.floor(F.col("soc_percent") + 0.5).cast("bigint").cast("string")
    observations = F.array_compact(F.array(
        F.when(waiting, "Cloud connected"),
        F.when(waiting, "Waiting for first telemetry"),
        F.when(no_state, "No Current State"),
        F.when(no_state | no_status, F.concat(F.lit("Last heard "), age_text(heard, now, long=True), F.lit(" ago"))),
        F.when(no_status, "Runtime status not yet observed"),
        F.when(F.lit(device_data_enabled) & ~F.col("has_device_data"), "Device Data not observed"),
        F.when(old_charge, F.concat(F.lit("Last reported SOC "), soc, F.lit("%"))),
        F.when(old_charge, F.concat(F.lit("SOC observation is "), age_text(F.col("soc_observed_at"), now), F.lit(" old"))),
        F.when(serial, F.concat(F.lit("Recent serial activity; cloud last heard "), age_text(F.col("last_heard"), now), F.lit(" ago"))),
        F.when(overdue, F.concat(F.lit("Expected application report "), age_text(F.col("expected_next_report"), now, long=True), F.lit(" ago"))),
    ))
    return rows.select("device_id", "device_name", F.posexplode(observations).alias("position", "observation"))


def recent_activity(rows: DataFrame, limit: int | None = ACTIVITY_LIMIT) -> DataFrame:
    """Latest activity per device, newest first: the last event, or cloud contact when there is none.

    Devices whose last event came from the serial collector are left out.
    """
    shown = present(rows.select(
        "device_id", "device_name", "last_event_time", "last_heard", "is_connected",
        F.col("last_event_type").alias("event_type"), F.col("last_source_type").alias("source_type"), "severity",
    ))
    reported = F.col("last_event_time").isNotNull()
    cloud = ~reported & F.coalesce(F.col("is_connected"), F.lit(False)) & F.col("last_heard").isNotNull()
    kept = shown.filter(cloud | (reported & (F.col("kind") != "COLLECTOR")))
    out = kept.select(
        "device_id", "device_name",
        F.when(reported, F.col("last_event_time")).otherwise(F.col("last_heard")).alias("time"),
        F.when(reported, F.col("kind")).otherwise("EVENT").alias("kind"),
        F.when(reported, F.col("summary")).otherwise("Connected to cloud").alias("summary"),
        F.when(reported, "current-state").otherwise("product-inventory").alias("source"),
    ).orderBy(F.col("time").desc(), "device_name", "device_id")
    return out.limit(limit) if limit is not None else out
