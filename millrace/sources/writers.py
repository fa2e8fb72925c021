"""Sinks: rows to the caller, nowhere, NDJSON files, HTTP, Kafka, and a table that takes every batch once."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collect_rows(df: DataFrame, most: int = 1_000_000) -> list[dict]:
    """The rows, for results that are meant for the driver; more than ``most`` are an error, not a heap of memory."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def discard(df: DataFrame) -> None:
    """Runs everything and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_ndjson(df: DataFrame, path: str, single: bool = False) -> None:
    """One JSON object per line; a folder of files, or one file for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def to_kafka(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as Kafka messages: the value is the row in JSON."""
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct("*")).alias("value"))


def to_frames(df: DataFrame) -> DataFrame:
    """The rows as Arrow IPC streams, one for each batch, in a column ``value``; ``read_frames`` reads them."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["value"])

    return df.mapInArrow(run, "value binary")


def post_batch(url: str, timeout: float = 30.0) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: posts every row as JSON, partition by partition; a status of 400 or more fails the batch."""

    def post(rows: Iterator) -> None:
        for row in rows:
            body = row["value"].encode()
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:  # errors raise
                if answer.status >= 400:
                    raise OSError(f"{url}: {answer.status}")

    return lambda df, _batch: df.select(F.to_json(F.struct("*")).alias("value")).foreachPartition(post)


def idempotent_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a Parquet table with a folder per batch, so that a batch that is run again replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/_batch={batch:020d}")

    return write


def as_json(rows: list[dict]) -> str:
    return "\n".join(json.dumps(r, default=str) for r in rows)
