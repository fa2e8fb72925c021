"""Top-N within count windows, for all rows or by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import number_rows


def top_n(df: DataFrame, by: str, n: int, size: int | None, order_by: list[str], key: str | list[str] | None = None, dear: bool = False) -> DataFrame:
    """The ``n`` rows of largest ``by`` in every window of ``size`` rows (None: one window), with ``rank`` from 1; ties go to the earlier row. ``dear`` as in number_rows."""
    keys = [key] if isinstance(key, str) else list(key or [])
    if size is None:
        placed = df.withColumn("window", F.lit(0).cast("bigint"))
    else:
        placed = number_rows(df, order_by, key=keys or None, dear=dear).withColumn("window", F.floor((F.col("_rn") - 1) / size).cast("bigint")).drop("_rn")
    w = W.partitionBy(*keys, "window").orderBy(F.desc(by), *order_by)
    return placed.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)
