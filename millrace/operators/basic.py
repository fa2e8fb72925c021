"""Projection, filtering, mapping, routing and set operations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Transform = Callable[[DataFrame], DataFrame]


def map_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Sets columns from expressions; one that reads a missing column fails when the plan is analysed."""
    return df.withColumns(columns)


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true; null is not."""
    return df.where(condition)


def flat_map(df: DataFrame, array: Column, name: str, keep: list[str] | None = None) -> DataFrame:
    """A row for each element of an array, none for an empty or null one."""
    return df.select(*(df.columns if keep is None else keep), F.explode(array).alias(name))


def set_constant(df: DataFrame, field: str, value) -> DataFrame:
    return df.withColumn(field, F.lit(value))


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Renames a column, if it is there, over any column of the new name."""
    if old not in df.columns or old == new:
        return df
    return df.drop(new).withColumnRenamed(old, new)


def tag(df: DataFrame, side: str, name: str = "_side") -> DataFrame:
    """Marks the rows of one side of a join of mixed rows."""
    return df.withColumn(name, F.lit(side))


def split(df: DataFrame, n: int, route: Column) -> list[DataFrame]:
    """``n`` frames by route index; an index below 1, too large or null goes to route 0.

    The frames share the plan of ``df``; cache it first if it is dear and the routes are run apart.
    """
    if n < 1:
        raise ValueError("split needs at least one route")
    index = F.coalesce(F.when((route > 0) & (route < n), route.cast("int")), F.lit(0))
    return [df.where(index == i) for i in range(n)]


def merge(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, by column name; columns that a frame lacks are null."""
    if not frames:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def branch(df: DataFrame, *chains: list[Transform]) -> DataFrame:
    """Every chain gets all rows; their results are merged. An empty chain passes the rows on."""
    if len(chains) < 2:
        raise ValueError("a branch has two chains at least")
    return merge(*[reduce(lambda d, f: d.transform(f), chain, df) for chain in chains])


def distinct_union(*frames: DataFrame) -> DataFrame:
    return merge(*frames).distinct()


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b.select(*a.columns))


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b.select(*a.columns))


def assign_timestamp(df: DataFrame, field: str, name: str = "_event_time") -> DataFrame:
    """Event time from a timestamp, from text in ISO form, or from whole Unix seconds (fractions are cut off); null where it is none of them."""
    kind = df.schema[field].dataType
    column = F.col(field)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        value = column.cast("timestamp")
    elif isinstance(kind, T.StringType):
        value = F.try_to_timestamp(column)
    elif isinstance(kind, T.NumericType):
        value = F.timestamp_seconds(column.cast("bigint"))
    else:
        value = F.lit(None).cast("timestamp")
    return df.withColumn(name, value)
