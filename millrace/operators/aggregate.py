"""Global and keyed aggregation. Spark combines map-side and then by key; ``merge_partials`` does the second step for stored partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.specs import aggregates, merge_aggregates, zero_nulls


def global_aggregate(df: DataFrame, spec: str, null_mode: str = "sql") -> DataFrame:
    """One row; sums of no rows are 0."""
    columns = aggregates(spec, null_mode)
    out = df.agg(*columns)
    return out.select(*[F.coalesce(c, F.lit(0)).cast(out.schema[c].dataType).alias(c) if c == "count" or c.startswith("sum") else F.col(c) for c in out.columns])


def max_or_none(df: DataFrame, field: str, out: str) -> DataFrame:
    """One row with the largest value, or no row if there is none."""
    return df.agg(F.max(field).alias(out)).where(F.col(out).isNotNull())


def group_by(df: DataFrame, key: str | list[str], spec: str | list[Column], null_mode: str = "sql", ordered: bool = False) -> DataFrame:
    """Aggregates by key. In null_mode ``zero`` null keys and values count as "" and 0; with ``ordered`` the rows are sorted by key."""
    keys = [key] if isinstance(key, str) else key
    if null_mode == "zero":
        df = zero_nulls(df, keys)
    out = df.groupBy(*keys).agg(*(aggregates(spec, null_mode) if isinstance(spec, str) else spec))
    return out.orderBy(*keys) if ordered else out


def merge_partials(df: DataFrame, key: str | list[str], spec: str) -> DataFrame:
    """Folds rows that ``group_by`` with the same spec gave for parts of the data."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(*merge_aggregates(spec))


def rollup_cube(df: DataFrame, keys: list[str], spec: str | list[Column], cube: bool = False) -> DataFrame:
    """Sub-totals over prefixes of the keys, or over all their subsets, with ``_level``, Spark's grouping id."""
    grouped = df.cube(*keys) if cube else df.rollup(*keys)
    return grouped.agg(F.grouping_id().alias("_level"), *(aggregates(spec) if isinstance(spec, str) else spec))
