"""Operators that take Python functions: map, filter and flat map over Arrow batches, and aggregates with partial results.

They are for what expressions can't say; everything else stays in the JVM.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Keys whose partial results a task holds before it hands them on.
HELD_KEYS = 100_000


def _schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in to_arrow_schema(schema)], names=schema.names)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """``fn`` of every Arrow batch."""
    return df.mapInArrow(lambda batches: map(fn, batches), _schema(schema))


def flat_map_rows(df: DataFrame, fn: Callable[[dict], Iterable[dict]], schema: T.StructType | str) -> DataFrame:
    """The rows that ``fn`` gives for each row, none or many; for a map it gives one."""
    schema = _schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([out for row in batch.to_pylist() for out in fn(row)], schema)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType | str) -> DataFrame:
    return flat_map_rows(df, lambda row: (fn(row),), schema)


def filter_by(df: DataFrame, fn: Callable[[dict], bool]) -> DataFrame:
    """Rows for which ``fn`` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(fn(r)) for r in batch.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def aggregate_by(df: DataFrame, key: str, zero: Callable[[], object], add: Callable[[object, dict], object], merge: Callable[[object, object], object], result: Callable[[object], dict], schema: T.StructType | str) -> DataFrame:
    """A user's aggregate by key: ``zero``, ``add`` a row, ``merge`` two partial results, ``result``.

    Every task folds its own rows first, so a hot key sends a partial result from each task and not its rows. ``schema`` has the result's columns without the key.
    """
    schema = _schema(schema)
    partial = T.StructType([df.schema[key], T.StructField("_part", T.BinaryType())])
    full = T.StructType([df.schema[key], *schema.fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            return _batch([{key: k, "_part": pickle.dumps(v)} for k, v in held.items()], partial)

        for batch in batches:
            for row in batch.to_pylist():
                k = row[key]
                held[k] = add(held[k] if k in held else zero(), row)
            if len(held) > HELD_KEYS:
                yield out()
                held.clear()
        if held:
            yield out()

    def finish(table: pa.Table) -> pa.Table:
        parts = map(pickle.loads, table.column("_part").to_pylist())
        total = next(parts)
        for p in parts:
            total = merge(total, p)
        return pa.Table.from_batches([_batch([{key: table.column(key)[0].as_py(), **result(total)}], full)])

    return df.mapInArrow(fold, partial).groupBy(key).applyInArrow(finish, full)
