"""Rows of the keyed steps travel as one text a row, with every value as it was."""

import datetime
import json

from pyspark.sql import Row
from pyspark.sql.types import DateType, StructField, StructType

from fleetlake.streaming import keyed

SCHEMA = StructType([*keyed.struct("device string, n long, x double, ok boolean, note string, code int").fields, StructField("day", DateType())])
DAY = datetime.date(2024, 1, 1)
ROWS = [
    ("a", 2**62 + 1, 0.1 + 0.2, True, 'line "1"\né\U0001f600 \\  ', 7, DAY),
    ("b", None, None, None, None, None, None),
    (None, -1, -0.0, False, "", 0, DAY),
    ("c", 0, 1e300, None, "null", -5, None),
]


def test_step_takes_and_returns_whole_rows_from_few_cells(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    sent = keyed.packed(rows, ["device"])
    assert sent.columns == ["device", "day", keyed.PACKED]  # plain columns are one cell
    operator = keyed.Keyed(None, "n long", ["n"], rows.columns, SCHEMA, None)
    operator.row = Row(*operator.apart, keyed.PACKED)
    taken = [operator.read(r) for r in sent.collect()]
    assert [tuple(r[c] for c in SCHEMA.names) for r in taken] == ROWS
    assert all(set(r) == set(SCHEMA.names) for r in taken)
    returned = spark.createDataFrame([tuple(operator.written(r)) for r in taken], StructType([*keyed.loose(SCHEMA), *keyed.struct(f"{keyed.PACKED} string")]))
    assert [tuple(r) for r in keyed.unpacked(returned, SCHEMA).collect()] == ROWS
    assert "n" not in json.loads(operator.written(taken[1])[-1])  # absent values take no room
