"""Numeric coercion, text rendering and time helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_HOUR = 3_600_000_000


def whole_number(text: Column) -> Column:
    """Number of the whole text: blank text is 0, empty or non-numeric text is null."""
    value = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    value = F.when((text != "") & (F.trim(text) == ""), F.lit(0.0)).otherwise(value)
    return F.when(F.abs(value) < float("inf"), value)


def prefix_number(text: Column) -> Column:
    """Number at the start of the text, ignoring what follows it."""
    return F.regexp_extract(text, NUMBER_PREFIX, 1).try_cast("double")


def number_text(value: Column) -> Column:
    """Shortest text of a number; whole numbers carry no decimal part."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def fixed_text(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def iso(ts: Column) -> Column:
    """ISO-8601 text with milliseconds, the external form of every instant."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_columns(df):
    """Render every top-level timestamp column as ISO text."""
    return df.select(*[
        iso(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("timestamp", "timestamp_ntz") else F.col(f.name)
        for f in df.schema.fields
    ])


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def age_text(since: Column, as_of: Column, long: bool = False) -> Column:
    """Age bucket: seconds, minutes, hours up to two days, then days."""
    sec = F.greatest(F.lit(0), F.floor(micros_between(since, as_of) / F.lit(1_000_000.0))).cast("bigint")
    minutes = F.floor(sec / F.lit(60)).cast("bigint")
    hours = F.floor(minutes / F.lit(60)).cast("bigint")
    days = F.floor(hours / F.lit(24)).cast("bigint")

    def label(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"))

    return (
        F.when(since.isNull() | as_of.isNull(), "unknown")
        .when(sec < 60, label(sec, "sec"))
        .when(minutes < 60, label(minutes, "minutes" if long else "min"))
        .when(hours < 48, label(hours, "hours" if long else "hr"))
        .when(days == 1, label(days, "day"))
        .otherwise(label(days, "days"))
    )
