"""Registry of named queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlake.functions.values import iso_columns
from fleetlake.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; instants leave as ISO text, so that both engines compare the same values."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return iso_columns(build(prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def load() -> None:
    from fleetlake.plans import catalog_device, catalog_events, catalog_fleet, catalog_sequence, catalog_stream  # noqa: F401
