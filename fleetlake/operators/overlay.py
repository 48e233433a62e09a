"""Overlay of nested JSON documents on any path: objects are merged key by key, whatever else an override holds replaces what lay there.

A document becomes rows (path, value): one for each value that is not an object, and one for each object without members. Two documents
meet by joins on their paths, so documents of any shape and size are merged, and a null that an override states stays a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlake.session import cut_lineage

DEPTH = 64  # levels of nesting; a deeper document raises an error
EMPTY = "{}"


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def leaves(documents: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value): the values of a JSON document by their path, an array of names; ``value`` is JSON text.

    One step per level of nesting opens the objects of that level. Null and unreadable documents, and anything but an object, have no rows.
    """
    level = documents.select(F.col(key), F.try_parse_json(F.col(column)).alias("_v")).where(_is_object(F.col("_v")))
    level = level.select(key, F.array().cast("array<string>").alias("path"), "_v")
    found = None
    for _ in range(DEPTH):
        opened = level.select(key, "path", F.explode(F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>"))).alias("_e"))
        members = cut_lineage(opened.select(key, F.array_append("path", F.col("_e.key")).alias("path"), F.col("_e.value").alias("_v")).withColumn(
            "_object", _is_object(F.col("_v")) & (F.to_json("_v") != EMPTY)))
        values = members.where(~F.col("_object")).select(key, "path", F.coalesce(F.to_json("_v"), F.lit("null")).alias("value"))
        found = values if found is None else found.unionByName(values)
        level = members.where("_object").select(key, "path", "_v")
        if level.isEmpty():
            return found
    raise ValueError(f"a document is nested deeper than {DEPTH} levels")


def _above(rows: DataFrame, key: str) -> DataFrame:
    """All paths that lead to these, without them."""
    ups = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))
    return rows.where(F.size("path") > 1).select(key, F.explode(ups).alias("path")).distinct()


def overlaid(defaults: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """(key, path, value, source) of the merged documents, from the leaves of both; source is ``default`` or ``override``.

    An override's value replaces the default's at its path and all below it; its objects merge, an empty one changes nothing where the default has an object.
    """
    on = [key, "path"]
    opened = _above(overrides, key)  # where the override has an object with members
    plain = overrides.where(F.col("value") != EMPTY).select(*on)
    # Defaults stay unless the override has a value at their path or above it, or an object with members in place of theirs.
    covered = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))
    spots = defaults.withColumn("_own", F.col("path")).withColumn("path", F.explode(covered))
    hit = spots.join(plain, on, "left_semi").select(key, F.col("_own").alias("path"))
    emptied = overrides.where(F.col("value") == EMPTY).select(*on)
    # An empty object replaces a default that is no object.
    gone = hit.unionByName(opened).unionByName(emptied).distinct()
    kept = defaults.join(gone, on, "left_anti").withColumn("source", F.lit("default"))
    inside = _above(defaults, key)
    own = overrides.join(inside, on, "left_semi").where(F.col("value") == EMPTY).select(*on)
    return kept.unionByName(overrides.join(own, on, "left_anti").withColumn("source", F.lit("override")))
