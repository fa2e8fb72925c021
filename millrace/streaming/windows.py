"""Event-time windows and interval joins over streams, and a way to close all windows of a stream that has ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.specs import duration, seconds
from ..operators.windows import Spec, _columns, _keys


def _timed(df: DataFrame, ts: str) -> bool:
    return isinstance(df.schema[ts].dataType, T.TimestampType | T.TimestampNTZType)


def _span(value, timed: bool) -> str:
    """A duration, or a number of ``ts``'s own units, which count as milliseconds."""
    return duration(value) if timed else f"{int(value)} milliseconds"


def _windowed(df: DataFrame, ts: str, window: Callable[[Column, bool], Column], spec: Spec, key, lateness) -> DataFrame:
    """Timestamps give ``window_start`` and ``window_end``, numbers ``ts``, the start.

    Rows are late that are older than the latest less ``lateness``; a stream's time begins at 0, so windows that end before are late from the start.
    """
    timed = _timed(df, ts)
    at = ts if timed else "_at"
    marked = df if timed else df.where(F.col(ts).isNotNull()).withColumn(at, F.timestamp_millis(F.col(ts).cast("bigint")))
    out = marked.withWatermark(at, _span(lateness, timed)).groupBy(window(F.col(at), timed).alias("_w"), *_keys(key)).agg(*_columns(spec))
    rest = [c for c in out.columns if c != "_w"]
    if timed:
        return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *rest)
    return out.select(F.unix_millis("_w.start").alias(ts), *rest)


def stream_tumbling(df: DataFrame, ts: str, size, spec: Spec, key=None, lateness=0) -> DataFrame:
    """Windows leave when the watermark, the latest time less ``lateness``, reaches their end; later rows of theirs are dropped and counted."""
    return _windowed(df, ts, lambda c, timed: F.window(c, _span(size, timed)), spec, key, lateness)


def stream_sliding(df: DataFrame, ts: str, size, hop, spec: Spec, key=None, lateness=0) -> DataFrame:
    return _windowed(df, ts, lambda c, timed: F.window(c, _span(size, timed), _span(hop, timed)), spec, key, lateness)


def stream_sessions(df: DataFrame, ts: str, gap, spec: Spec, key, lateness=0) -> DataFrame:
    return _windowed(df, ts, lambda c, timed: F.session_window(c, _span(gap, timed)), spec, key, lateness)


def stream_interval_join(left: DataFrame, right: DataFrame, key: str, ts: str, window, lateness=0) -> DataFrame:
    """Pairs of a key at most ``window`` apart. A row is late if it is older than the latest time of either side less ``lateness`` and ``window``.

    Both sides have a watermark of that delay, and the later of the two counts: the session's policy for several watermarks is set to max.
    """
    left.sparkSession.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    timed = _timed(left, ts)
    delay = duration(seconds(lateness) + seconds(window)) if timed else f"{int(lateness) + int(window)} milliseconds"
    moment = lambda c: F.col(c) if timed else F.timestamp_millis(F.col(c).cast("bigint"))
    names = {c: c if c not in left.columns else f"{c}_r" for c in right.columns if c != key}
    l = left.withColumn("_lat", moment(ts)).withWatermark("_lat", delay)  # noqa: E741
    r = right.select(F.col(key).alias("_rkey"), moment(ts).alias("_rat"), *[F.col(c).alias(f"_r_{c}") for c in names]).withWatermark("_rat", delay)
    width = F.expr(f"interval {_span(window, timed)}")
    joined = l.join(r, (F.col(key) == F.col("_rkey")) & F.col("_rat").between(F.col("_lat") - width, F.col("_lat") + width))
    return joined.select(*left.columns, *[F.col(f"_r_{c}").alias(name) for c, name in names.items()])


def drain(write_last: Callable[[], None], query) -> None:
    """Closes the windows of a stream over files: processes what is there, has ``write_last`` add a row far in the future, and processes that.

    The row's own window stays open. Leave it out of results after the sink, never by a filter in the query: pushed below the watermark it would keep the watermark back.
    """
    query.processAllAvailable()
    write_last()
    query.processAllAvailable()
