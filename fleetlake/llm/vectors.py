"""Which embedding rows the vector operators take: complete vectors of the table's dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(vector: str) -> Column:
    """Whether a vector is there, not empty, and has finite numbers only."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def sized(rows: DataFrame, vector: str) -> tuple[DataFrame, int, int]:
    """Complete vectors of the commonest dimension (the larger one of equally common ones), that dimension and their number."""
    whole = rows.where(complete(vector))
    most = whole.groupBy(F.size(vector).alias("d")).count().sort(F.desc("count"), F.desc("d")).first()
    if most is None:
        return whole, 0, 0
    return whole.where(F.size(vector) == most["d"]), most["d"], most["count"]
