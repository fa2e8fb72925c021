"""Dedup over event time, and the last row of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import keyed_count_window


def deduplicate(df: DataFrame, key: str, ts: str, window, order_by: list[str]) -> DataFrame:
    """Drops a row that comes less than ``window`` after the last row of its key that was kept; dropped rows don't extend it.

    ``ts`` is a timestamp, with ``window`` a duration in seconds, or both are numbers. A window of 0 keeps all rows. Rows with a null
    time are kept. Kept rows of a key are found by a fold over its times in order; the rows themselves are then joined to them.
    """
    if not window:
        return df
    from pyspark.sql import types as T

    from ..functions.specs import seconds

    timed = isinstance(df.schema[ts].dataType, T.TimestampType | T.TimestampNTZType)
    at = F.unix_micros(F.col(ts).cast("timestamp")) if timed else F.col(ts).cast("bigint")
    least = round(seconds(window) * 1_000_000) if timed else int(window)
    item = F.struct(at.alias("at"), *[F.col(c) for c in order_by])
    rows = df.withColumn("_item", item)
    known = rows.where(F.col(ts).isNotNull())
    # A row that is `window` after the row before it is kept whatever came earlier: there a chain of its own begins, and each chain is folded alone.
    w = W.partitionBy(key).orderBy("_item")
    chained = known.select(key, "_item", F.when(F.col("_item.at") - F.lag("_item.at").over(w) < least, 0).otherwise(1).alias("_new"))
    chained = chained.withColumn("_chain", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    lists = chained.groupBy(key, "_chain").agg(F.sort_array(F.collect_list("_item")).alias("_all"))
    kind = known.schema["_item"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast(f"array<{kind}>").alias("kept"))
    fold = F.aggregate(
        "_all",
        start,
        lambda acc, x: F.when(acc["last"].isNull() | (x["at"] - acc["last"] >= least), F.struct(x["at"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc),
    )
    kept = lists.select(key, F.explode(fold["kept"]).alias("_item"))
    same = [known[key].eqNullSafe(kept[key]), known["_item"].eqNullSafe(kept["_item"])]
    return known.join(kept, same, "left_semi").drop("_item").unionByName(rows.where(F.col(ts).isNull()).drop("_item"))


def keep_last(df: DataFrame, key: str | list[str], size: int, order_by: list[str]) -> DataFrame:
    """The last row of every window of ``size`` rows of a key."""
    keys = [key] if isinstance(key, str) else key
    last = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order_by)).alias("_last")
    return keyed_count_window(df, keys, size, [last], order_by).select("window", "_last.*")
