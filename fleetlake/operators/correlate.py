"""Correlation windows: classified events, window assembly and the inference rules.

Windows are aggregates and evidence is one row per line, so a window with millions of events never becomes one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlake.functions.values import iso, micros_between, number_text
from fleetlake.operators.archive import payload_metrics, with_payload
from fleetlake.operators.ordered import AUTO, Slices
from fleetlake.operators.sequence import anchored_windows

WINDOW = ["device_id", "window_start"]
SERIAL_WIRE = ["SERIAL_CONNECTED", "SERIAL_DISCONNECTED", "SERIAL_MISSING"]
# Log categories in the order they are tested, reconnect before connect.
LOG_CATEGORIES = [
    ("reconnect", ["reconnect", "retry"]), ("modem", ["modem", "cellular"]), ("network", ["network", "connect"]),
    ("power", ["power", "battery"]), ("error", ["error", "fail"]),
]
# What windows and evidence read of a member.
MEMBER = [
    *WINDOW, "event_time", "event_name", "log_line", "class", "member", "log_category", "lifecycle", "reset_cause",
    "battery", "connect_time", "reset_count", "alert_count",
]
TELEMETRY_METRICS = ["battery", "connect_time", "temperature", "reset_count", "alert_count", "occupancy"]


def correlation_class(events: DataFrame) -> Column:
    name = F.lower("event_name")
    source = F.coalesce(F.nullif(F.col("source_event_type"), F.lit("")), F.col("event_type"))
    has_line = F.coalesce(F.col("log_line") != "", F.lit(False))
    return (
        F.when(name.contains("watchdog"), "watchdog")
        .when(name.contains("status") | name.contains("state"), "status")
        .when((F.col("event_type") == "serial.lifecycle") | source.isin(SERIAL_WIRE), "serial-lifecycle")
        .when((F.col("event_type") == "serial.log") | ((F.col("source_type") == "serial-forwarder") & has_line), "serial-log")
        .otherwise("telemetry")
    )


def log_category(line: Column) -> Column:
    lower = F.lower(F.coalesce(line, F.lit("")))
    out = None
    for name, words in LOG_CATEGORIES:
        hit = lower.contains(words[0]) | lower.contains(words[1])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def lifecycle_kind() -> Column:
    source = F.coalesce(F.nullif(F.col("source_event_type"), F.lit("")), F.col("event_type"), F.col("event_name"))
    return (
        F.when(source.isin(SERIAL_WIRE), source)
        .when(F.col("log_line").contains("MODEM_HEALTH"), "MODEM_HEALTH").otherwise("OTHER")
    )


def details(events: DataFrame) -> DataFrame:
    """Class-specific details of every event; needs the payload columns of ``payload_metrics``."""
    def optional(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")) if name in events.columns else F.lit(None).cast("string")

    cls = F.col("class")
    status = (cls == "status") & F.col("has_payload")
    watchdog = (cls == "watchdog") & F.col("has_payload")
    return events.withColumn("class", correlation_class(events)).withColumns({
        "log_category": F.when(cls == "serial-log", log_category(F.col("log_line"))),
        "lifecycle": F.when(cls == "serial-lifecycle", lifecycle_kind()),
        "reset_cause": F.when(watchdog, optional("archived_reset_cause")),
        "cloud_recover_stage": F.when(status, F.try_element_at("content", F.lit("cloudRecoverStage"))).try_cast("double"),
        "status_network_state": F.when(status, F.try_element_at("content", F.lit("networkState"))),
        "status_queue_depth": F.when(status, F.try_element_at("content", F.lit("queueDepth"))).try_cast("double"),
        "detail": F.when(watchdog, F.coalesce(optional("archived_details"), optional("archived_message")))
        .when(status, F.when(F.col("content").isNotNull(), F.to_json("content")))
        .when(cls == "serial-lifecycle", F.col("log_line")),
        # A telemetry event counts only with a payload and at least one metric.
        "member": F.when(cls == "telemetry", F.col("has_payload") & F.coalesce(*[F.col(m) for m in TELEMETRY_METRICS]).isNotNull())
        .when(cls.isin("watchdog", "status"), F.col("has_payload")).otherwise(True),
    })


def window_members(events: DataFrame, archive: DataFrame, minutes: float = 5, slices: Slices | str | None = AUTO) -> DataFrame:
    """Every event with its window, class and extracted details. Windows come first, so that payloads are joined once."""
    return details(payload_metrics(with_payload(anchored_windows(events, minutes, slices), archive)))


def windows(members: DataFrame) -> DataFrame:
    """One row per window: bounds, class sizes and the facts the rules test. Partial aggregation, nothing is collected."""
    cls, member = F.col("class"), F.col("member")
    connect, battery, alerts = (F.when((cls == "telemetry") & member, F.col(c)) for c in ("connect_time", "battery", "alert_count"))
    resets = F.when((cls == "telemetry") & member, F.col("reset_count"))
    reset_at = F.when(resets.isNotNull(), F.col("event_time"))

    def size(name: str) -> Column:
        return F.count_if((cls == name) & member)

    facts = members.groupBy(*WINDOW).agg(
        F.max("event_time").alias("window_end"), F.count(F.lit(1)).alias("event_count"),
        size("telemetry").alias("n_telemetry"), size("watchdog").alias("n_watchdog"), size("status").alias("n_status"),
        size("serial-lifecycle").alias("n_lifecycle"), size("serial-log").alias("n_log"),
        F.max(connect).alias("max_connect"),
        F.min(F.when(battery != 0, battery)).alias("min_battery"), F.max(alerts).alias("max_alerts"),
        F.count_if(F.col("log_category").isin("modem", "error")).alias("n_modem"),
        F.count_if(F.col("log_category") == "reconnect").alias("n_reconnect"),
        F.count_if(F.col("lifecycle") == "SERIAL_CONNECTED").alias("n_connected"),
        F.count_if(F.col("lifecycle") == "SERIAL_DISCONNECTED").alias("n_disconnected"),
        F.count(resets).alias("n_resets"),
        F.min_by(resets, reset_at).alias("first_resets"), F.max_by(resets, reset_at).alias("last_resets"),
    )
    minutes = micros_between(F.col("window_start"), F.col("window_end")) / F.lit(60_000_000.0)
    return facts.withColumn("duration_minutes", F.round(minutes, 1))


def inferences(windows_: DataFrame) -> DataFrame:
    """One row per fired rule. Rules 7 and 8 speak only when no earlier rule of their category did."""
    connect, battery, alerts = F.col("max_connect"), F.col("min_battery"), F.col("max_alerts")
    increase = F.col("last_resets") - F.col("first_resets")
    r1 = (F.col("n_telemetry") > 0) & (F.col("n_log") > 0) & (connect > 60) & (F.col("n_modem") > 0)
    r2 = (F.col("n_connected") > 1) | (F.col("n_disconnected") > 1)
    r3 = (F.col("n_watchdog") > 0) & (F.col("n_telemetry") > 0) & (connect > 120)
    r4 = (F.col("n_watchdog") > 0) & (F.col("n_telemetry") > 1) & (F.col("n_resets") > 1) & (increase > 0)
    r5 = (battery < 30) & (alerts > 0)
    r6 = F.col("n_reconnect") >= 2

    def fired(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    r7 = (connect > 180) & ~(fired(r1) | fired(r3) | fired(r6))
    r8 = (battery < 20) & ~fired(r5)

    def inference(rule: int, severity: str, category: str, message: Column) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message")
        )

    def n(c: str) -> Column:
        return F.col(c).cast("string")

    usb = F.concat(F.lit("USB instability detected: "), n("n_connected"), F.lit(" connect, "), n("n_disconnected"), F.lit(" disconnect events"))
    reboot = F.concat(F.lit("Device reboot detected: reset count increased by "), number_text(increase))
    loop = F.concat(F.lit("Reconnect loop detected: "), n("n_reconnect"), F.lit(" reconnect attempts"))
    found = F.array_compact(F.array(
        F.when(r1, inference(1, "WARNING", "connectivity", F.lit("Connectivity degradation detected: High connection time with modem errors"))),
        F.when(r2, inference(2, "WARNING", "hardware", usb)),
        F.when(r3, inference(3, "CRITICAL", "connectivity", F.lit("Network stall likely caused watchdog reset"))),
        F.when(r4, inference(4, "CRITICAL", "stability", reboot)),
        F.when(r5, inference(5, "CRITICAL", "power", F.lit("Power anomaly: Low battery with active alerts"))),
        F.when(r6, inference(6, "WARNING", "connectivity", loop)),
        F.when(r7, inference(7, "WARNING", "connectivity", F.lit("High cellular connection time detected"))),
        F.when(r8, inference(8, "CRITICAL", "power", F.lit("Critical battery level detected"))),
    ))
    kept = ["event_count", "first_resets", "last_resets"]
    return windows_.select(*WINDOW, *kept, F.explode(found).alias("i")).select(*WINDOW, "i.*", *kept)


def inference_summary(found: DataFrame) -> DataFrame:
    """Totals per device by severity and category."""
    return found.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "WARNING", "INFO")],
        *[F.count_if(F.col("category") == c).alias(c) for c in ("connectivity", "power", "stability", "hardware")],
    )


def evidence(members: DataFrame, found: DataFrame) -> DataFrame:
    """One row per evidence line of a fired rule; order by part, then event time.

    Members of windows in which a rule fired are kept first, then each event makes the lines of the fired rules;
    no window is collected.
    """
    fired = found.groupBy(*WINDOW).agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("fired"))
    members = members.join(fired, WINDOW)
    cls, member = F.col("class"), F.col("member")
    telemetry, watchdog = (cls == "telemetry") & member, (cls == "watchdog") & member
    at = iso(F.col("event_time"))
    connect, battery, alerts = F.col("connect_time"), F.col("battery"), F.col("alert_count")
    line = F.substring(F.coalesce("log_line", F.lit("")), 1, 60)
    cause = F.coalesce(F.col("reset_cause"), F.col("event_name"))

    def or_missing(c: Column) -> Column:
        return F.coalesce(number_text(c), F.lit("undefined"))

    connect_line = F.concat(F.lit("connecttime="), number_text(connect), F.lit("s at "), at)
    power_line = F.concat(F.lit("battery="), or_missing(battery), F.lit("%, alerts="), or_missing(alerts), F.lit(" at "), at)

    def candidate(rule: int, part: int, condition: Column, text: Column) -> Column:
        wanted = F.col("fired").bitwiseAND(1 << rule) != 0
        return F.when(wanted & condition, F.struct(F.lit(rule).alias("rule"), F.lit(part).alias("part"), text.alias("line")))

    lines = F.array_compact(F.array(
        candidate(1, 1, telemetry & (connect > 60), connect_line),
        candidate(1, 2, F.col("log_category").isin("modem", "error"), F.concat("log_category", F.lit(": "), line)),
        candidate(2, 1, F.col("lifecycle").isNotNull(), F.concat("lifecycle", F.lit(" at "), at)),
        candidate(3, 1, watchdog, F.concat(F.lit("watchdog: "), cause, F.lit(" at "), at)),
        candidate(3, 2, telemetry & (connect > 120), connect_line),
        candidate(4, 1, watchdog, F.concat(F.lit("watchdog: "), cause)),
        candidate(5, 1, telemetry & (((battery != 0) & (battery < 30)) | (alerts > 0)), power_line),
        candidate(6, 1, F.col("log_category") == "reconnect", F.concat(line, F.lit(" at "), at)),
        candidate(7, 1, telemetry & (connect > 180), connect_line),
        candidate(8, 1, telemetry & (battery != 0) & (battery < 20), F.concat(F.lit("battery="), number_text(battery), F.lit("% at "), at)),
    ))
    per_event = members.select(*WINDOW, "event_time", F.explode(lines).alias("c")).select(*WINDOW, "event_time", "c.*")
    counts = found.filter(F.col("rule") == 4).select(
        *WINDOW, F.lit(None).cast("timestamp").alias("event_time"), "rule", F.lit(2).alias("part"),
        F.concat(F.lit("reset count: "), number_text(F.col("first_resets")), F.lit(" → "), number_text(F.col("last_resets"))).alias("line"),
    )
    return per_event.select(*WINDOW, "event_time", "rule", "part", "line").unionByName(counts)
