"""Joins: dimensions, intervals, bounded mixed streams, side tables, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side of at most so many bytes, by the plan's statistics, is broadcast; of others Spark decides when it has seen their sizes.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a batch frame for broadcasting if it can't be larger than ``size``. Nothing is computed for that: files know their sizes, and what filters and aggregates leave is no more."""
    if df.isStreaming:
        return df
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if estimate <= size else df


def hash_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, bring: dict[str, str], how: str = "inner", multi: bool = False, build_order: list[str] | None = None, null_mode: str = "sql") -> DataFrame:
    """Probe columns and those brought from the build side (``{field: name}``).

    Without ``multi`` the last build row of a key in ``build_order`` counts; with it, each. ``how`` is any of Spark's; rows
    without a match have null in what was brought (0 and "" in null_mode ``zero`` only where the build row has null).
    """
    from ..functions.specs import zero_nulls

    picked = build.select(F.col(build_key).alias("_key"), *[F.col(f).alias(f"_b_{name}") for f, name in bring.items()], *([F.struct(*build_order).alias("_order")] if build_order and not multi else []))
    if null_mode == "zero":
        picked, probe = zero_nulls(picked), zero_nulls(probe, [probe_key])
    if not multi:
        if build_order is None:
            raise ValueError("the last build row of a key is meant: build_order is needed, or multi=True")
        values = F.struct(*[F.col(f"_b_{name}") for name in bring.values()]) if bring else F.struct(F.lit(1))
        picked = picked.groupBy("_key").agg(F.max_by(values, "_order").alias("_v")).select("_key", *([F.col(f"_v._b_{name}") for name in bring.values()] if bring else []))
    joined = probe.join(small(picked), F.col(probe_key) == F.col("_key"), how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return joined
    brought = set(bring.values())
    return joined.select(*[F.col(c) for c in probe.columns if c not in brought], *[F.col(f"_b_{name}").alias(name) for name in bring.values()])


def interval_join(left: DataFrame, right: DataFrame, key: str, ts: str, window, bucket: bool = False) -> DataFrame:
    """Pairs of equal keys with |left ts - right ts| <= window: all left columns, then the right ones without the key, ``_r`` added where a name is taken.

    ``ts`` is a timestamp, with ``window`` a duration, or a number. With ``bucket`` rows also meet by time bucket, so that a hot key is
    spread over its buckets (batch only); every pair still meets once.
    """
    from pyspark.sql import types as T

    from ..functions.specs import duration, seconds

    timed = isinstance(left.schema[ts].dataType, T.TimestampType | T.TimestampNTZType)
    names = {c: c if c not in left.columns else f"{c}_r" for c in right.columns if c != key}
    r = right.select(F.col(key).alias("_rkey"), *[F.col(c).alias(f"_r_{c}") for c in names])
    width = F.expr(f"interval {duration(window)}") if timed else F.lit(window)
    near = F.col(f"_r_{ts}").between(F.col(ts) - width, F.col(ts) + width)
    on: Column = (F.col(key) == F.col("_rkey")) & near
    if bucket:
        size = max(1, round(seconds(window) * 1_000_000) if timed else int(window))
        number = lambda c: F.floor((F.unix_micros(F.col(c).cast("timestamp")) if timed else F.col(c)) / size).cast("bigint")
        left = left.withColumn("_bucket", number(ts))
        r = r.withColumn("_rbucket", F.explode(F.array(*[number(f"_r_{ts}") + d for d in (-1, 0, 1)])))
        on = on & (F.col("_bucket") == F.col("_rbucket"))
    joined = left.join(r, on)
    return joined.select(*[c for c in left.columns if c != "_bucket"], *[F.col(f"_r_{c}").alias(name) for c, name in names.items()])


def bounded_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, most: int, seq: str, columns: list[Column], skewed: bool = False) -> DataFrame:
    """Joins one stream of two kinds of rows, each of which remembers its last ``most`` rows per key.

    A row meets the ``most`` rows of the other side that came last before it. ``seq`` orders both sides together. ``columns`` are taken from ``l`` and ``r``;
    ``_seq`` and ``_with`` order the result as it would come out. One shuffle by key and one sort: the rows met are the last ones of the other side
    that are not null, by lag. With ``skewed`` no key's rows have to fit in a task: rows are numbered by ranges, and the join is on (key, number).
    """
    if most < 1:
        raise ValueError("at least one row must be remembered")
    l = left.select(F.col(left_key).alias("_k"), F.col(seq).alias("_seq"), F.struct(F.col(seq).alias("_at"), F.struct(*left.columns).alias("v")).alias("l"))  # noqa: E741
    r = right.select(F.col(right_key).alias("_k"), F.col(seq).alias("_seq"), F.struct(F.col(seq).alias("_at"), F.struct(*right.columns).alias("v")).alias("r"))
    both = l.unionByName(r, allowMissingColumns=True).where(F.col("_k").isNotNull())
    if skewed:
        return _bounded_by_number(both, most).select("_seq", "_with", *columns)
    seen = lambda c: F.array_compact(F.array(*[F.expr(f"lag({c}, {i}) IGNORE NULLS OVER (PARTITION BY _k ORDER BY _seq)") for i in range(1, most + 1)]))
    met = both.withColumn("_ls", F.when(F.col("r").isNotNull(), seen("l"))).withColumn("_rs", F.when(F.col("l").isNotNull(), seen("r")))
    late_r = met.where("r is not null").select("_seq", F.col("r.v").alias("r"), F.explode("_ls").alias("_o")).select("_seq", F.col("_o._at").alias("_with"), F.col("_o.v").alias("l"), "r")
    late_l = met.where("l is not null").select("_seq", F.col("l.v").alias("l"), F.explode("_rs").alias("_o")).select("_seq", F.col("_o._at").alias("_with"), "l", F.col("_o.v").alias("r"))
    return late_r.unionByName(late_l).select("_seq", "_with", *columns)


def _bounded_by_number(both: DataFrame, most: int) -> DataFrame:
    """Numbers by key among all rows and among those of a side tell how many of the other side came before."""
    from .ordering import number_rows, stored

    all_rows = stored(number_rows(both, ["_seq"], "_n", key=["_k"], skewed=True), "numbered")
    ls = stored(number_rows(all_rows.where("l is not null").select("_k", "_seq", "_n", F.col("l.v").alias("l")), ["_seq"], "_l", key=["_k"], skewed=True), "left")
    rs = stored(number_rows(all_rows.where("r is not null").select("_k", "_seq", "_n", F.col("r.v").alias("r")), ["_seq"], "_r", key=["_k"], skewed=True), "right")
    seen = lambda before: F.explode(F.when(before > 0, F.sequence(F.greatest(before - (most - 1), F.lit(1)), before)))
    late_r = rs.select("_k", "_seq", "r", seen(F.col("_n") - F.col("_r")).alias("_o")).join(ls.select("_k", F.col("_l").alias("_o"), "l", F.col("_seq").alias("_with")), ["_k", "_o"])
    late_l = ls.select("_k", "_seq", "l", seen(F.col("_n") - F.col("_l")).alias("_o")).join(rs.select("_k", F.col("_r").alias("_o"), "r", F.col("_seq").alias("_with")), ["_k", "_o"])
    return late_r.unionByName(late_l)


def side_lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, name: str, default="") -> DataFrame:
    """Adds a value looked up in a table with one row per key; a miss gives the default."""
    t = table.select(F.col(table_key).alias("_key"), F.col(value).alias("_value"))
    return df.join(small(t), F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_value", F.lit(default))).drop("_key", "_value")


def as_of_join(left: DataFrame, right: DataFrame, key: str, ts: str, bring: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row of its key that is not later: one shuffle by key and a running value."""
    l = left.withColumn("_side", F.lit(1))  # noqa: E741
    r = right.select(key, ts, F.struct(*[F.col(c) for c in bring]).alias("_v")).withColumn("_side", F.lit(0))
    w = W.partitionBy(key).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, *[F.col(f"_v.{c}").alias(f"{c}_r" if c in left.columns else c) for c in bring])
