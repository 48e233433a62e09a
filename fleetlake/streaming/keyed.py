"""Keyed state of the streaming jobs: a state store holds what each key needs, so that a batch costs what its own rows cost.

A step sees the rows of one key in one batch, as dicts in order, and the key's saved value; it returns rows and the value to save. The state store is
RocksDB with change logs, so a batch writes the keys it touched. Spark deals keys to tasks and hands rows over one by one: most keys have few rows
in a batch, so that a data frame for each key would cost many times the work on its rows. Spark turns every cell of a row into a Python value by a call
of its own, which costs more than the steps do; plain columns therefore travel as one text a row, both ways. The rows of one key in one batch are
held by its task, which the trigger bounds (``maxFilesPerTrigger``). Backlogs
are folded in batch first, where large keys are cut into slices, and continue from there (``initial``).

Instants travel as microseconds. Steps are pure: a batch that runs again starts from the same saved values and gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


KINDS = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType()}


def struct(columns: str) -> StructType:
    """The type of ``name kind, ...``, for modules that are imported before a session is there."""
    return StructType([StructField(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


PACKED = "_packed"
PLAIN = (StringType, LongType, IntegerType, DoubleType, BooleanType)  # types whose values keep their kind and every digit as JSON


def loose(schema: StructType) -> StructType:
    """The columns that travel as such."""
    return StructType([f for f in schema if not isinstance(f.dataType, PLAIN)])


def packed(rows: DataFrame, key: list[str]) -> DataFrame:
    """The key, the columns that are not plain, and the plain ones as one JSON text; absent values are left out of it."""
    apart = loose(rows.schema).names
    text = F.to_json(F.struct(*[c for c in rows.columns if c not in apart], F.lit(1).alias(PACKED)))
    return rows.select(*key, *[c for c in apart if c not in key], text.alias(PACKED))


def unpacked(rows: DataFrame, schema: StructType) -> DataFrame:
    apart = loose(schema).names
    plain = StructType([f for f in schema if f.name not in apart])
    read = rows.withColumn(PACKED, F.from_json(PACKED, plain))
    return read.select(*[F.col(c if c in apart else f"{PACKED}.{c}").alias(c) for c in schema.names])


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else each partition's store takes 4 MB of disk when it is opened


def in_micros(df: DataFrame) -> DataFrame:
    """Instants as microseconds."""
    return df.select(*[F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name) for f in df.schema])


def from_micros(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.timestamp_micros(n) for n in names if n in df.columns})


def place(row: dict, order: list[str]) -> tuple:
    """Where a row stands in an order; absent values come first."""
    return tuple(v for c in order for v in (row[c] is not None, row[c]))


class Memory:
    """Small values by name that a key remembers until they are dropped."""

    def __init__(self, values):
        self.values = values

    def get(self, name: str) -> tuple | None:
        return self.values.getValue((name,)) if self.values.containsKey((name,)) else None

    def put(self, name: str, value: tuple) -> None:
        self.values.updateValue((name,), value)

    def drop(self, name: str) -> None:
        self.values.removeKey((name,))

    def items(self) -> list[tuple[str, tuple]]:
        return [(k[0], v) for k, v in self.values.iterator()]


Step = Callable[[list[dict], dict | None, Memory | None], tuple[list[dict], dict | None]]


class Keyed(StatefulProcessor):
    """Applies ``step(rows, saved, memory)`` per key; rows and ``saved`` are dicts, ``saved`` is None for a new key."""

    def __init__(self, step: Step, state: str, order: list[str], columns: list[str], output: StructType, remembered: str | None):
        self.step, self.schema, self.order, self.remembered = step, state, order, remembered
        self.fields, self.absent, self.apart = struct(state).names, dict.fromkeys(columns), loose(output).names
        self.plain = [c for c in output.names if c not in self.apart]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value, self.memory, self.row = handle.getValueState("saved", self.schema), None, Row(*self.apart, PACKED)
        if self.remembered:
            self.memory = Memory(handle.getMapState("remembered", "name string", self.remembered))

    def read(self, row: Row) -> dict:
        cells = dict(zip(row.__fields__, row))
        read = {**self.absent, **cells, **json.loads(cells[PACKED])}
        del read[PACKED]
        return read

    def written(self, row: dict) -> Row:
        return self.row(*map(row.get, self.apart), json.dumps({c: row[c] for c in self.plain if row.get(c) is not None}))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ordered = sorted(map(self.read, rows), key=lambda r: place(r, self.order))
        saved = self.value.get()
        out, new = self.step(ordered, dict(zip(self.fields, saved)) if saved is not None else None, self.memory)
        if new is not None:
            self.value.update(tuple(new[f] for f in self.fields))
        return map(self.written, out)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.value.update(tuple(initialState[f] for f in self.fields))

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, key: list[str], step: Step, state: str, order: list[str], output: str | StructType, initial: DataFrame | None = None,
          remembered: str | None = None) -> DataFrame:
    """The rows that ``step`` returns for the keys of every batch.

    ``initial`` has the state's fields of keys to start from; ``remembered`` is the type of the small values that a key may remember.
    """
    use_state_store(rows.sparkSession)
    made = struct(output) if isinstance(output, str) else output
    sent = StructType([*loose(made), StructField(PACKED, StringType())])
    returned = packed(rows, key).groupBy(*key).transformWithState(
        statefulProcessor=Keyed(step, state, order, rows.columns, made, remembered), outputStructType=sent,
        outputMode="append", timeMode="none", initialState=initial.groupBy(*key) if initial is not None else None,
    )
    return unpacked(returned, made)
