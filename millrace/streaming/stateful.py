"""Stateful stream operators that Spark has no built-in form of: greedy dedup, count windows, the bounded mixed join.

State is kept by key through ``applyInPandasWithState``; within a batch a key's rows are sorted by their time or number first and
worked on as arrays. With ``idle`` the state of a key that gets no rows for so long ends, and what it holds leaves; else it stays for good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.specs import seconds


def _timeout(idle) -> str:
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def _keep(state: GroupState, value: tuple, idle) -> None:
    state.update(value)
    if idle is not None:
        state.setTimeoutDuration(max(1, round(seconds(idle) * 1000)))


def stream_deduplicate(df: DataFrame, key: str, ts: str, window: float) -> DataFrame:
    """Drops a row that comes less than ``window`` seconds after the last row of its key that passed. State of a key ends a window after the watermark has passed it."""
    if not window:
        return df
    least = int(window * 1_000_000)
    timed = df.withColumn("_at", F.unix_micros(ts)).withWatermark(ts, f"{least} microseconds")

    def step(_key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("_at", kind="stable")
        at, keep = rows["_at"].to_numpy(), []
        k = 0 if last is None else int(np.searchsorted(at, last + least))
        while k < len(at):  # from one row that passes to the next
            keep.append(k)
            last = int(at[k])
            k = max(k + 1, int(np.searchsorted(at, last + least)))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + least // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[keep].drop(columns="_at").reset_index(drop=True)

    return timed.groupBy(key).applyInPandasWithState(step, df.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


_KINDS = {"count": T.LongType(), "sum": T.DoubleType(), "sumi": T.LongType(), "max": T.DoubleType(), "min": T.DoubleType(), "avg": T.DoubleType()}


def stream_count_aggregate(df: DataFrame, key: str | None, size: int, spec: str, seq: str, plain: bool = False, idle=None) -> DataFrame:
    """(key, window, aggregates) of every ``size`` rows of a key, or of all rows, in the order of ``seq`` within a batch.

    ``spec`` may ask for count, sum, sumi, max, min and avg. What is left at the end stays in the state, or leaves after ``idle``.
    """
    asked = [tuple(p.strip().partition(":")[::2]) for p in spec.split(",") if p.strip()]
    unknown = [k for k, f in asked if k not in _KINDS or bool(f) == (k == "count")]
    if unknown or not asked:
        raise ValueError(f"a stream's count windows can't have {', '.join(unknown) or 'no aggregate'}")
    fields = sorted({f for _, f in asked if f})
    names = [k if k == "count" or plain and k == "sum" else f"{k}_{f}" for k, f in asked]
    rows = df.select(*([F.col(key)] if key else [F.lit(0).alias("_all")]), F.col(seq).alias("_order"), *[F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(fields)])
    head = rows.schema[0]
    schema = T.StructType([head, T.StructField("window", T.LongType()), *(T.StructField(n, _KINDS[k]) for n, (k, _) in zip(names, asked, strict=True))])
    doubles = T.ArrayType(T.DoubleType())
    state_schema = T.StructType([T.StructField("window", T.LongType()), T.StructField("rows", T.LongType()), *(T.StructField(n, doubles) for n in ("n", "total", "high", "low"))])
    empty = (0, 0, [0.0] * len(fields), [0.0] * len(fields), [-np.inf] * len(fields), [np.inf] * len(fields))

    def rows_of(k, window, count, n, total, high, low) -> pd.DataFrame:
        out = {head.name: [k] * len(window), "window": window}
        for name, (kind, f) in zip(names, asked, strict=True):
            i = fields.index(f) if f else 0
            with np.errstate(invalid="ignore", divide="ignore"):
                value = {"count": lambda: count, "sum": lambda: total[:, i], "sumi": lambda: total[:, i], "max": lambda: high[:, i], "min": lambda: low[:, i], "avg": lambda: total[:, i] / n[:, i]}[kind]()
            there = np.ones(len(window), bool) if kind == "count" else n[:, i] > 0
            out[name] = pd.array(np.where(there, value, 0), dtype="Int64" if kind in ("count", "sumi") else "Float64")
            out[name][~there] = pd.NA
        return pd.DataFrame(out, columns=schema.names)

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, have, n, total, high, low = state.get if state.exists else empty
        if state.hasTimedOut:
            state.remove()
            if have:
                yield rows_of(k[0], np.array([number]), np.array([have]), *(np.array([x]) for x in (n, total, high, low)))
            return
        got = pd.concat(list(batches)).sort_values("_order", kind="stable")
        at = (have + np.arange(len(got))) // size
        windows = int(at[-1]) + 1
        starts = np.searchsorted(at, np.arange(windows))
        if fields:
            v = got[[f"_v{i}" for i in range(len(fields))]].to_numpy(np.float64, na_value=np.nan)
            there = ~np.isnan(v)
            parts = [np.add.reduceat(there.astype(np.float64), starts), np.add.reduceat(np.where(there, v, 0), starts), np.maximum.reduceat(np.where(there, v, -np.inf), starts), np.minimum.reduceat(np.where(there, v, np.inf), starts)]
            for x, old, fold in zip(parts, (n, total, high, low), (np.add, np.add, np.maximum, np.minimum), strict=True):
                x[0] = fold(x[0], old)
        else:
            parts = [np.zeros((windows, 0))] * 4
        counts = np.bincount(at, minlength=windows)
        counts[0] += have
        full = windows if counts[-1] == size else windows - 1
        rest = (number + full, 0, *empty[2:]) if full == windows else (number + full, int(counts[-1]), *(x[-1].tolist() for x in parts))
        _keep(state, rest, idle)
        yield rows_of(k[0], number + np.arange(full), counts[:full], *(x[:full] for x in parts))

    out = rows.groupBy(head.name).applyInPandasWithState(step, schema, state_schema, "append", _timeout(idle))
    return out if key else out.drop("_all")


def stream_count_window(df: DataFrame, key: str, size: int, value: str, seq: str, idle=None) -> DataFrame:
    """(key, window, count, sum) of every ``size`` rows of a key, in the order of ``seq`` within a batch."""
    return stream_count_aggregate(df, key, size, f"count, sum:{value}", seq, plain=True, idle=idle)


def stream_bounded_join(df: DataFrame, key: str, side: str, left: str, right: str, most: int, seq: str, value: str, idle=None) -> DataFrame:
    """(key, left value, right value) for every row and the last ``most`` rows of the other side before it, from one stream of both sides."""
    kind = df.schema[value].dataType
    schema = T.StructType([df.schema[key], T.StructField("l", kind), T.StructField("r", kind)])
    state_schema = T.StructType([T.StructField("ls", T.ArrayType(kind)), T.StructField("rs", T.ArrayType(kind))])

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = [list(x) for x in state.get] if state.exists else [[], []]
        rows = pd.concat(list(batches)).sort_values(seq, kind="stable")
        sides, values = rows[side].to_numpy(), rows[value].to_numpy(object)
        is_left, is_right = sides == left, sides == right
        ls, rs = (np.array([*o, *values[mine].tolist()], object) for o, mine in zip(old, (is_left, is_right), strict=True))
        out = []
        # A row meets, of the other side, the rows numbered from so many before it back to `most` before.
        for mine, theirs, other, before in ((is_left, is_right, rs, len(old[1])), (is_right, is_left, ls, len(old[0]))):
            seen = before + np.cumsum(theirs)[mine]
            for back in range(1, most + 1):
                ok = seen >= back
                pair = (values[mine][ok], other[seen[ok] - back])
                out.append(pair if mine is is_left else pair[::-1])
        _keep(state, (ls[-most:].tolist(), rs[-most:].tolist()), idle)
        l, r = (np.concatenate([x[i] for x in out]) for i in (0, 1))
        yield pd.DataFrame({schema.names[0]: [k[0]] * len(l), "l": l, "r": r})

    return df.groupBy(key).applyInPandasWithState(step, schema, state_schema, "append", _timeout(idle))
