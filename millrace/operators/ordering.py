"""A total order as consecutive numbers, without putting all rows into one partition."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a folder of this process only where that is unset and Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a table in the shared folder: computed once, in fixed partitions, and safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task may number, where the caller says that the rows may be few.
FEW_ROWS = 100_000


def number_rows(df: DataFrame, order_by: list[str | Column], name: str = "_rn", key: list[str] | None = None, skewed: bool = False, dear: bool = False) -> DataFrame:
    """Adds 1, 2, 3, ... in the given order, by key if there is one. ``order_by`` must tell all rows apart.

    With a key, a window over the key's rows does it; with ``skewed`` or without a key, rows are dealt out by ranges of the
    order, numbered within their partition, and shifted by the number of rows in the partitions before, so that
    neither all rows nor one key's rows have to fit in a task. ``dear`` rows (of an aggregate, say) are stored first, so that
    finding the ranges doesn't compute them twice; if they turn out to be at most FEW_ROWS, one window numbers them.
    """
    if not order_by:
        raise ValueError("rows have no order of their own: order_by is needed")
    if key and not skewed:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order_by)).cast("bigint"))
    if dear:
        df = stored(df, "dear")
        if not key and df.count() <= FEW_ROWS:
            return df.withColumn(name, F.row_number().over(W.orderBy(*order_by)).cast("bigint"))
    order = [F.col(k) for k in key or []] + [F.col(c) if isinstance(c, str) else c for c in order_by]
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(ordered, "ordered")
    part = F.shiftright("_at", 33)
    # One row per partition: its offset is the number of rows before it.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    numbered = numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")
    if not key:
        return numbered
    first = numbered.groupBy(*key).agg(F.min(name).alias("_first")).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)], "_first")
    joined = numbered.join(first, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)])
    return joined.select(*df.columns, (F.col(name) - F.col("_first") + 1).alias(name))
