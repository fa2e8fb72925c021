"""Count windows over an explicit order, and event-time windows over timestamps or whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.specs import aggregates, duration
from .ordering import number_rows

Spec = str | list[Column]


def _columns(spec: Spec, plain: bool = False) -> list[Column]:
    return aggregates(spec, plain=plain) if isinstance(spec, str) else list(spec)


def count_tumbling(df: DataFrame, size: int, spec: Spec, order_by: list[str], plain: bool = False) -> DataFrame:
    """A row for every ``size`` rows in order, and one for the rest; ``window`` is its number from 0."""
    if size < 1:
        raise ValueError("a window has a row at least")
    numbered = number_rows(df, order_by)
    return numbered.groupBy(F.floor((F.col("_rn") - 1) / size).cast("bigint").alias("window")).agg(*_columns(spec, plain))


def count_sliding(df: DataFrame, size: int, step: int, spec: Spec, order_by: list[str]) -> DataFrame:
    """After every ``step`` rows, and at the end, the last ``size`` rows or as many as there are; ``window`` is the number of the last row.

    Each row goes to the windows it is in, size / step of them and one at the end, so no row has to see its neighbours.
    """
    if not size >= step >= 1:
        raise ValueError("size >= step >= 1 is needed")
    numbered = number_rows(df, order_by)
    total = numbered.agg(F.max("_rn").alias("_total"))
    rn, first = F.col("_rn"), F.ceil(F.col("_rn") / step) * step
    steps = F.filter(F.sequence(first, rn + (size - 1) + step, F.lit(step).cast("bigint")), lambda e: (e <= rn + (size - 1)) & (e <= F.col("_total")))
    ends = F.array_distinct(F.concat(steps, F.when(F.col("_total") - rn < size, F.array("_total")).otherwise(F.array().cast("array<bigint>"))))
    placed = numbered.crossJoin(F.broadcast(total)).withColumn("window", F.explode(ends))  # `total` is one row
    return placed.groupBy("window").agg(*_columns(spec))


def keyed_count_window(df: DataFrame, key: str | list[str], size: int, spec: Spec, order_by: list[str], skewed: bool = False) -> DataFrame:
    """As ``count_tumbling``, for each key apart."""
    if size < 1:
        raise ValueError("a window has a row at least")
    keys = [key] if isinstance(key, str) else key
    if skewed and isinstance(spec, str):  # rows are stored on the way: only what is asked for
        asked = {p.partition(":")[2].strip() for p in spec.split(",")} - {""}
        df = df.select(*dict.fromkeys([*keys, *order_by, *sorted(asked)]))
    numbered = number_rows(df, order_by, key=keys, skewed=skewed)
    return numbered.groupBy(*keys, F.floor((F.col("_rn") - 1) / size).cast("bigint").alias("window")).agg(*_columns(spec))


def _is_time(df: DataFrame, ts: str) -> bool:
    return isinstance(df.schema[ts].dataType, T.TimestampType | T.TimestampNTZType)


def _keys(key: str | list[str] | None) -> list[str]:
    return [] if key is None else [key] if isinstance(key, str) else key


def event_tumbling(df: DataFrame, ts: str, size, spec: Spec, key: str | list[str] | None = None, start: str | None = None) -> DataFrame:
    """Windows of one size, by key if there is one. ``ts`` is a timestamp and ``size`` a duration, or both are numbers.

    Timestamps give ``window_start`` and ``window_end``, numbers ``ts``, the start. ``start`` shifts windows from the epoch.
    """
    if _is_time(df, ts):
        window = F.window(ts, duration(size), startTime=start) if start else F.window(ts, duration(size))
        out = df.groupBy(window.alias("_w"), *_keys(key)).agg(*_columns(spec))
        return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])
    bucket = (F.col(ts) - F.pmod(F.col(ts), F.lit(size).cast("bigint"))).alias("_start")
    return df.where(F.col(ts).isNotNull()).groupBy(bucket, *_keys(key)).agg(*_columns(spec)).withColumnRenamed("_start", ts)


def event_sliding(df: DataFrame, ts: str, size, hop, spec: Spec, key: str | list[str] | None = None) -> DataFrame:
    """A row counts in every window that begins at a multiple of ``hop`` in (ts - size, ts]."""
    if _is_time(df, ts):
        out = df.groupBy(F.window(ts, duration(size), duration(hop)).alias("_w"), *_keys(key)).agg(*_columns(spec))
        return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])
    if not size >= hop > 0:
        raise ValueError("size >= hop > 0 is needed")
    h = F.lit(hop).cast("bigint")
    last = F.col(ts) - F.pmod(F.col(ts), h)
    low = F.col(ts) - size
    first = low - F.pmod(low, h) + h
    return df.where(F.col(ts).isNotNull()).withColumn("_start", F.explode(F.sequence(first, last, h))).groupBy("_start", *_keys(key)).agg(*_columns(spec)).withColumnRenamed("_start", ts)


def event_sessions(df: DataFrame, ts: str, gap, spec: Spec, key: str | list[str] | None = None) -> DataFrame:
    """Sessions: rows of a key that are at most ``gap`` apart, the gap included, belong together. Numbers give ``ts``, the start."""
    if _is_time(df, ts):
        out = df.groupBy(F.session_window(ts, duration(gap)).alias("_w"), *_keys(key)).agg(*_columns(spec))
        return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])
    keys = _keys(key)
    if not keys:
        raise ValueError("sessions over numbers need a key")
    w = W.partitionBy(*keys).orderBy(ts)
    new = F.when(F.col(ts) - F.lag(ts).over(w) <= gap, 0).otherwise(1)
    marked = df.where(F.col(ts).isNotNull()).withColumn("_new", new).withColumn("_session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_session").agg(F.min(ts).alias("_start"), *_columns(spec)).drop("_session").withColumnRenamed("_start", ts)
