"""Textual specifications of aggregates, comparisons, arithmetic and durations, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}  # fixed values: units of durations


def seconds(text: str | int | float) -> float:
    """Seconds of a duration such as ``1h30m``, ``250ms``, ``0`` or a number of seconds."""
    if isinstance(text, int | float) and not isinstance(text, bool):
        return float(text)
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", str(text))
    if str(text).strip() == "0":
        return 0.0
    if not parts or "".join(a + b for a, b in parts) != str(text).strip():
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


def duration(text: str | int | float) -> str:
    """The duration as Spark writes intervals, in microseconds."""
    return f"{round(seconds(text) * 1_000_000)} microseconds"


def aggregates(spec: str, null_mode: str = "sql", plain: bool = False) -> list[Column]:
    """Columns of a comma list: ``count``, ``sum:f`` (double), ``sumi:f`` (bigint), ``max:f``, and also ``min:f``, ``avg:f``,
    ``distinct:f``, ``approx:f``, ``stddev:f`` and ``median:f``. Names are ``count`` and ``kind_f`` (``sumi_f`` for sumi).

    ``plain`` names a sum just ``sum``. In null_mode ``zero`` nulls count as zeros, as in the columnar lane.
    """
    out = []
    for part in (p.strip() for p in spec.split(",") if p.strip()):
        kind, _, field = part.partition(":")
        if kind == "count" and not field:
            out.append(F.count(F.lit(1)).alias("count"))
            continue
        value = F.col(field) if field else None
        if value is None:
            raise ValueError(f"aggregate {part!r} needs a field")
        if null_mode == "zero":
            value = F.coalesce(value, F.lit(0))
        made = {
            "sum": lambda v: F.sum(v.cast("double")),
            "sumi": lambda v: F.sum(v.cast("bigint")),
            "max": F.max,
            "min": F.min,
            "avg": lambda v: F.avg(v.cast("double")),
            "distinct": F.count_distinct,
            "approx": F.approx_count_distinct,
            "stddev": F.stddev,
            "median": F.median,
        }.get(kind)
        if made is None:
            raise ValueError(f"unknown aggregate {part!r}")
        column = made(value)
        if null_mode == "zero" and kind in ("sum", "sumi", "max", "avg"):
            column = F.coalesce(column, F.lit(0))
        out.append(column.alias(kind if plain and kind == "sum" else f"{kind}_{field}"))
    if not out:
        raise ValueError("no aggregate")
    return out


def merge_aggregates(spec: str) -> list[Column]:
    """Columns that fold partial results of the same spec: counts and sums add up, extremes stay extremes."""
    out = []
    for part in (p.strip() for p in spec.split(",") if p.strip()):
        kind, _, field = part.partition(":")
        name = "count" if kind == "count" else f"{kind}_{field}"
        fold = {"count": F.sum, "sum": F.sum, "sumi": F.sum, "max": F.max, "min": F.min}.get(kind)
        if fold is None:
            raise ValueError(f"partial results of {kind!r} can't be merged")
        out.append(fold(F.col(name)).alias(name))
    return out


def compare(field: str, cmp: str, value) -> Column:
    """``field`` gte, lte or eq ``value`` (and gt, lt, ne); order is numeric, and what is no number fails it."""
    column = F.col(field)
    if cmp == "eq":
        return column == F.lit(value)
    if cmp == "ne":
        return column != F.lit(value)
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise ValueError(f"{cmp} needs a number, not {value!r}")
    number = column.try_cast("double")
    tests = {"gte": number >= value, "lte": number <= value, "gt": number > value, "lt": number < value}
    if cmp not in tests:
        raise ValueError(f"unknown comparison {cmp!r}")
    return tests[cmp]


def arithmetic(column: Column, op: str, value: int | float) -> Column:
    """add, sub, mul or div by a constant; whole numbers divide to whole numbers, towards zero."""
    if op not in ("add", "sub", "mul", "div"):
        raise ValueError(f"unknown arithmetic {op!r}")
    if op == "div" and value == 0:
        raise ValueError("division by zero")
    if isinstance(value, int):
        whole, value = True, F.lit(value).cast("bigint")
    else:
        whole, value = False, F.lit(value)
    if op == "div":
        return F.call_function("div", column, value) if whole else column / value
    return {"add": column + value, "sub": column - value, "mul": column * value}[op]


def zero_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numbers that are null become 0, texts "", booleans false."""
    def fill(out: DataFrame, f: T.StructField) -> DataFrame:
        zero = "" if isinstance(f.dataType, T.StringType) else False if isinstance(f.dataType, T.BooleanType) else 0 if isinstance(f.dataType, T.NumericType) else None
        return out if zero is None else out.withColumn(f.name, F.coalesce(f.name, F.lit(zero)).cast(f.dataType))

    return reduce(fill, [f for f in df.schema if columns is None or f.name in columns], df)
