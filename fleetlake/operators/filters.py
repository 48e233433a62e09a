"""Query parameters and predicates. Every instant is relative to the ``as_of`` the caller passes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

HEALTH_STATUSES = ("healthy", "warning", "critical", "unknown")
SEVERITIES = ("low", "medium", "high")
FULL_ID = "^[a-fA-F0-9]{24}$"


def utc(text: str | datetime) -> datetime:
    """Instant of an ISO text; a text without zone is UTC."""
    when = text if isinstance(text, datetime) else datetime.fromisoformat(str(text).replace("Z", "+00:00"))
    return when.replace(tzinfo=timezone.utc) if when.tzinfo is None else when.astimezone(timezone.utc)


def instant_text(when: datetime) -> str:
    return when.astimezone(timezone.utc).isoformat(timespec="microseconds")


@dataclass(frozen=True)
class QueryWindow:
    """Validated time range, row limit and minimum severity of a query."""

    start: datetime
    end: datetime
    limit: int
    severity: str | None = None

    @staticmethod
    def parse(
        params: dict[str, str], as_of: str | datetime, default_hours: float = 24, max_hours: float = 168,
        default_limit: int = 100, max_limit: int = 1000,
    ) -> QueryWindow:
        """Explicit start and end win over hours, hours over the default."""
        now = utc(as_of)
        if params.get("start") and params.get("end"):
            start, end = _instant(params["start"], "start"), _instant(params["end"], "end")
            if start >= end:
                raise ValueError("start must be before end")
            if end > now:
                raise ValueError("end cannot be in the future")
        else:
            hours = _number(params["hours"], "hours", max_hours) if params.get("hours") else default_hours
            start, end = now - timedelta(hours=hours), now
        limit = default_limit
        if params.get("limit"):
            text = re.match(r"\s*[+-]?\d+", params["limit"])
            if not text:
                raise ValueError(f"invalid limit: {params['limit']}")
            limit = int(_number(text.group(), "limit", max_limit))
        severity = params.get("severity") or None
        if severity and severity.lower() not in SEVERITIES:
            raise ValueError(f"invalid severity: {severity}, must be one of {SEVERITIES}")
        return QueryWindow(start, end, limit, severity.lower() if severity else None)


    @staticmethod
    def since(duration: str, as_of: str | datetime, limit: int = 25) -> QueryWindow:
        """The last ``30s``, ``5m`` or ``1h``."""
        now = utc(as_of)
        return QueryWindow(now - parse_duration(duration), now, limit)

    @staticmethod
    def starting(start: str, as_of: str | datetime, until: str | None = None, limit: int = 25) -> QueryWindow:
        """From an instant to another one or to now."""
        return QueryWindow(_instant(start, "start"), _instant(until, "until") if until else utc(as_of), limit)


def _instant(text: str, name: str) -> datetime:
    try:
        return utc(text)
    except ValueError:
        raise ValueError(f"invalid {name} time: {text}") from None


def _number(text: str, name: str, maximum: float) -> float:
    try:
        value = float(text)
    except ValueError:
        raise ValueError(f"invalid {name}: {text}") from None
    if not 0 < value <= maximum:
        raise ValueError(f"{name} must be above 0 and at most {maximum}, got {text}")
    return value


def parse_duration(text: str) -> timedelta:
    """``30s``, ``5m`` or ``1.5h``; a bare number is seconds."""
    match = re.fullmatch(r"\s*(\d+(?:\.\d+)?)([smh])?\s*", text, re.IGNORECASE)
    if not match:
        raise ValueError(f"not a duration: {text}")
    scale = {"s": 1, "m": 60, "h": 3600}[(match.group(2) or "s").lower()]
    return timedelta(milliseconds=int(float(match.group(1)) * scale * 1000))


def health_status(text: str | None) -> str | None:
    """Lower-case status name, None when not given."""
    if not text:
        return None
    if text.lower() not in HEALTH_STATUSES:
        raise ValueError(f"invalid status: {text}, must be one of {HEALTH_STATUSES}")
    return text.lower()


def events_between(events: DataFrame, start=None, end=None, device_id: str | None = None) -> DataFrame:
    """Closed time range of all devices or of one; plain column predicates, so they reach the scan.

    On a table partitioned by ``event_date`` the range also prunes directories.
    """
    dated = "event_date" in events.columns
    if device_id is not None:
        events = events.filter(F.col("device_id") == device_id)
    if start is not None:
        events = events.filter(F.col("event_time") >= F.lit(instant_text(utc(start))).cast("timestamp"))
        events = events.filter(F.col("event_date") >= F.lit(utc(start).date())) if dated else events
    if end is not None:
        events = events.filter(F.col("event_time") <= F.lit(instant_text(utc(end))).cast("timestamp"))
        events = events.filter(F.col("event_date") <= F.lit(utc(end).date())) if dated else events
    return events


def recent(df: DataFrame, time: str, hours: float, as_of: str) -> DataFrame:
    """At most ``hours`` before ``as_of``."""
    return df.filter(F.col(time) >= F.lit(instant_text(utc(as_of) - timedelta(hours=hours))).cast("timestamp"))


def offline(df: DataFrame, time: str, hours: float, as_of: str) -> DataFrame:
    """Strictly older than ``hours`` before ``as_of``."""
    return df.filter(F.col(time) < F.lit(instant_text(utc(as_of) - timedelta(hours=hours))).cast("timestamp"))


def select_devices(devices: DataFrame, selectors: DataFrame) -> DataFrame:
    """Match selectors to devices: full id, then exact name, then partial name, ignoring case.

    Returns one row per selector: ``device_id`` when unique, ``matches`` and ``match`` (id, exact, partial,
    ambiguous or none). Only a full id is taken for an id; a device without a name goes by its id. All three kinds are equality
    joins: a name offers its parts of the lengths that selectors have, so a partial match needs no check and no part that all names share is
    compared with each of them. Both sides of the join grow with their tables and are shuffled; only the distinct lengths reach the driver.
    """
    shown = F.coalesce(F.nullif(F.trim("device_name"), F.lit("")), F.col("device_id"))
    wanted = selectors.select("selector").distinct()
    full, lower = F.col("selector").rlike(FULL_ID), F.lower("selector")
    named = devices.select("device_id", F.lower(shown).alias("_name"))
    lengths = wanted.filter(~full & (F.length(lower) > 0)).agg(F.collect_set(F.length(lower))).scalar()

    def key(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("match"), text.alias("_key"))

    keys = F.when(full, F.array(key("id", F.col("selector")))).otherwise(F.array(key("exact", lower), key("partial", lower)))
    asks = wanted.select("selector", F.inline(keys)).filter(F.col("_key").isNotNull())
    whole = named.select("device_id", F.inline(F.array(key("id", F.col("device_id")), key("exact", F.col("_name")))))
    sized = named.withColumn("_size", F.explode(lengths)).filter(F.col("_size") <= F.length("_name"))
    offered = whole.unionByName(sized.select("device_id", F.lit("partial").alias("match"), F.explode(_parts(F.col("_name"), F.col("_size"))).alias("_key")))
    # The estimate of an exploded table knows nothing of its rows: without the hint it may be broadcast at any size.
    hits = offered.join(asks.hint("shuffle_hash"), ["match", "_key"]).select("selector", "match", "device_id")
    none = F.lit(None).cast("string")
    of = {k: F.when(F.col("match") == k, F.struct("device_id")) for k in ("id", "exact", "partial")}
    found = hits.unionByName(wanted.select("selector", none.alias("match"), none.alias("device_id"))).groupBy("selector").agg(
        *[F.struct(F.count(c).alias("matches"), F.min(c["device_id"]).alias("device_id"), F.lit(k).alias("match")).alias(k) for k, c in of.items()]
    )
    best = F.when(F.col("id.matches") > 0, F.col("id")).when(F.col("exact.matches") > 0, F.col("exact")).otherwise(F.col("partial"))
    return found.select("selector", best.alias("_best")).select("selector", "_best.*").select(
        "selector",
        F.when(F.col("matches") == 1, F.col("device_id")).alias("device_id"),
        "matches",
        F.when(F.col("matches") > 1, "ambiguous").when(F.col("matches") == 1, F.col("match")).otherwise("none").alias("match"),
    )


def _parts(text: Column, size: Column) -> Column:
    """Distinct parts of a text that have ``size`` letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda s: F.substr(text, s, size)))


def truncated(df: DataFrame, key: list[str], limit: int) -> DataFrame:
    """Per key: row count and whether the limit was reached."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count")).withColumn("truncated", F.col("row_count") >= limit)
