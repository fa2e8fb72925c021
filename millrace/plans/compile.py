"""Lowers a validated job to a DataFrame: every stage becomes a function of the merged results of its predecessors."""

from __future__ import annotations

import json
import uuid
import zlib
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import operators as ops
from ..functions.specs import arithmetic, compare, seconds
from ..operators.ordering import shared_dir
from ..sources import generator, http_landing, memory, post_batch, read_files
from ..sources.readers import parse_json
from ..streaming.observe import Quarantine
from .spec import PROFILES, Spec, Stage, load, use_profile

_operators: dict[str, Callable[..., DataFrame]] = {}
_sources: dict[str, Callable[..., DataFrame]] = {}
_sinks: dict[str, Callable[[DataFrame], object]] = {}


def register_operator(name: str, fn: Callable[..., DataFrame]) -> None:
    """Makes ``ref:name`` an operator: a function of a frame and the stage's parameters."""
    _operators[name] = fn


def register_source(name: str, fn: Callable[..., DataFrame]) -> None:
    """Makes ``ref:name`` a source: a function of the session and the source's parameters."""
    _sources[name] = fn


def register_sink(name: str, fn: Callable[[DataFrame], object]) -> None:
    _sinks[name] = fn


def _order(df: DataFrame) -> list[str]:
    """Arrival order: the number that sources give."""
    if "_seq" not in df.columns:
        raise ValueError("the order of rows is not known: the source must have a column _seq")
    return ["_seq"]


def _kept(df: DataFrame) -> DataFrame:
    """Windowed rows go on in the order of their windows."""
    return df.withColumnRenamed("window", "_seq") if "window" in df.columns else df


def _dedup(df: DataFrame, p: dict) -> DataFrame:
    if df.isStreaming:
        from ..streaming import stream_deduplicate

        return stream_deduplicate(df, p["key"], "_event_time", seconds(p.get("window", 0)))
    ts = "_event_time" if "_event_time" in df.columns else "_seq"
    window = p.get("window", "0s") if ts == "_event_time" else round(seconds(p.get("window", "0s")) * 1000)  # generated rows are a millisecond apart
    return ops.deduplicate(df, p["key"], ts, window, _order(df))


def _tumbling(df: DataFrame, p: dict) -> DataFrame:
    if df.isStreaming:
        from ..streaming import stream_count_aggregate

        return _kept(stream_count_aggregate(df, None, p["size"], p.get("agg") or "count", _order(df)[0], plain=True))
    return _kept(ops.count_tumbling(df, p["size"], ops_spec(p), _order(df)))


def _stream_join(df: DataFrame, p: dict) -> DataFrame:
    hidden = [c for c in ("_side", "_seq", "_event_time") if c in df.columns]
    sides = [df.where(F.col("_side") == p[side]).drop(*hidden) for side in ("left", "right")]
    if df.isStreaming:
        from ..streaming import stream_interval_join

        return stream_interval_join(*sides, p["key"], p["ts"], p["window"], p.get("lateness") or 0)
    return ops.interval_join(*sides, p["key"], p["ts"], p["window"], bucket=True)  # a hot key is spread over its buckets


def _vec_map(df: DataFrame, p: dict) -> DataFrame:
    value, kind = p["value"], df.schema[p["field"]].dataType
    whole = isinstance(kind, T.IntegralType)
    return df.withColumn(p["field"], arithmetic(F.col(p["field"]), p.get("arith", "add"), value if whole else float(value)))


def _vec_join(df: DataFrame, p: dict) -> DataFrame:
    bring = dict((x.split(":", 1) if ":" in x else (x, x)) for x in p["bring"])
    rows = [{**r, "_n": k} for k, r in enumerate(p["build"])]
    build = memory(df.sparkSession, rows)
    return ops.hash_join(df, build, p["key"], p.get("build_key") or p["key"], bring, "left" if p.get("left") else "inner", bool(p.get("multi")), ["_n"])


def _filter(df: DataFrame, p: dict) -> DataFrame:
    cmp = p.get("cmp") or next((k for k in ("gte", "lte", "eq") if k in p), "gte")
    return df.where(compare(p["field"], cmp, p.get("value", p.get(cmp))))


def _event_window(df: DataFrame, p: dict) -> DataFrame:
    if df.isStreaming:
        df = df.withWatermark("_event_time", f"{round(seconds(p.get('lateness', 0)) * 1000)} milliseconds")
    return ops.event_tumbling(df, "_event_time", p["size"], ops_spec(p))


def _session(df: DataFrame, p: dict) -> DataFrame:
    if df.isStreaming:
        df = df.withWatermark("_event_time", f"{round(seconds(p.get('lateness', 0)) * 1000)} milliseconds")
    return ops.event_sessions(df, "_event_time", p["gap"], ops_spec(p), p["key"])


def _vec_window(kind: str, *sizes: str) -> Callable[[DataFrame, dict], DataFrame]:
    """Windows by key over a number: complete ones for a batch; over a stream those that the watermark, less ``lateness``, has passed."""

    def lower(df: DataFrame, p: dict) -> DataFrame:
        from .. import streaming

        args = (p["ts"], *[p[s] for s in sizes], p.get("agg") or "count", p["key"])
        if df.isStreaming:
            return getattr(streaming, f"stream_{kind}")(df.drop("_event_time"), *args, p.get("lateness") or 0)
        return getattr(ops, f"event_{kind}")(df, *args)

    return lower


def ops_spec(p: dict):
    from ..functions.specs import aggregates

    return aggregates(p.get("agg") or "count", plain=True)


LOWER: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "filter": _filter,
    "map-set": lambda df, p: ops.set_constant(df, p["field"], p["value"]),
    "map-rename": lambda df, p: ops.rename(df, p["from"], p["to"]),
    "dedup": _dedup,
    "tumbling": _tumbling,
    "timestamp": lambda df, p: ops.assign_timestamp(df, p["field"]),
    "eventwindow": _event_window,
    "session": _session,
    "to-batch": lambda df, p: ops.tag(df, p["id"]) if p.get("id") else df,
    "to-rows": lambda df, p: df,
    "vec-filter": lambda df, p: df.where(compare(p["field"], p.get("cmp", "gte"), p["value"])),
    "vec-map": _vec_map,
    "vec-join": _vec_join,
    "vec-groupby": lambda df, p: ops.group_by(df, p["key"], p.get("agg") or "count"),
    "vec-tumbling": _vec_window("tumbling", "size"),
    "vec-sliding": _vec_window("sliding", "size", "hop"),
    "vec-session": _vec_window("sessions", "gap"),
    "vec-streamjoin": _stream_join,
}


@dataclass
class Built:
    """A job with the frame that reaches its sink, the frames after each stage, and the receiver and the rejects of its source if it has any."""

    spec: Spec
    frame: DataFrame
    stages: dict[str, DataFrame]
    receiver: object = None
    rejects: DataFrame | None = None

    def run(self):
        """Hands the result to the sink: rows for ``memory``, nothing for ``http``, what the function returns for ``ref:``.

        A stream is run over what is there now, and its rows are those of the ``memory`` sink.
        """
        from ..sources import collect_rows

        if self.frame.isStreaming:
            running = self.start(available=True)
            running.query.awaitTermination()
            return list(running.rows)
        kind = self.spec.sink.type
        if kind.startswith("ref:"):
            return _sinks[kind[4:]](self.frame)
        if kind == "http":
            return post_batch(self.spec.sink.params["url"])(self.frame, 0)
        return collect_rows(self.frame.drop("_seq", "_side"))

    def start(self, checkpoint: str | None = None, available: bool = False, keep: int = 10_000) -> Running:
        """Starts a streaming job. It goes on where the checkpoint, by default one of the job's name and source in the shared folder, says it was."""
        if not self.frame.isStreaming:
            raise ValueError(f"{self.spec.name} is no stream: run it")
        return Running(self, checkpoint, available, keep)

    def close(self) -> None:
        if self.receiver is not None:
            self.receiver.close()


class Running:
    """A started streaming job. ``rows`` holds the last rows that left it, ``total`` their number, ``quarantine`` what its source could not read."""

    def __init__(self, built: Built, checkpoint: str | None, available: bool, keep: int) -> None:
        self.built, self.rows, self.total, self._batch = built, deque(maxlen=keep), 0, -1
        spark, spec = built.frame.sparkSession, built.spec
        before = spark.conf.get("spark.sql.shuffle.partitions")
        more = use_profile(spark, spec.profile) if spec.profile else {}
        try:
            writer = built.frame.drop("_side").writeStream.outputMode("append").foreachBatch(self.deliver).queryName(spec.name)
            source = zlib.crc32(json.dumps([spec.source.type, spec.source.params], sort_keys=True, default=str).encode())
            place = checkpoint or f"{shared_dir(spark)}/jobs/{spec.name}-{source:08x}"
            writer = writer.option("checkpointLocation", place)
            if available:
                writer = writer.trigger(availableNow=True)
            elif "trigger" in more:
                writer = writer.trigger(processingTime=more["trigger"])
            self.query = writer.start()  # a stream keeps the options of its start
            self.quarantine, self._rejects = Quarantine(), None
            if built.rejects is not None and not available:
                self._rejects = built.rejects.writeStream.foreachBatch(self.quarantine.sink).option("checkpointLocation", f"{place}-rejects").start()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    def deliver(self, df: DataFrame, batch: int) -> None:
        """Hands a batch to the sink. The same batch comes again after a failure: sinks must bear that, as ``idempotent_batch`` does."""
        kind = self.built.spec.sink.type
        if kind.startswith("ref:"):
            fn = _sinks[kind[4:]]
            fn(df, batch) if len(signature(fn).parameters) > 1 else fn(df)
        elif kind == "http":
            post_batch(self.built.spec.sink.params["url"])(df, batch)
        elif batch > self._batch:
            got = df.drop("_seq").limit(self.rows.maxlen).collect()
            self.rows.extend(r.asDict(recursive=True) for r in got)
            self.total += len(got)
        self._batch = batch

    def stop(self) -> None:
        self.query.stop()
        if self._rejects is not None:
            self._rejects.stop()
        self.built.close()


def _source(spark: SparkSession, spec: Spec, rows: list[dict] | None, bounded: int | None) -> DataFrame | tuple[DataFrame, object]:
    kind, p = spec.source.type, spec.source.params
    if kind.startswith("ref:"):
        if kind[4:] not in _sources:
            raise ValueError(f"no source is registered as {kind[4:]!r}")
        return _sources[kind[4:]](spark, **p)
    if kind == "generator":
        return generator(spark, p.get("fields") or {}, p.get("rows") or bounded, p.get("rate"))
    if kind == "memory":
        given = rows if rows is not None else p.get("rows") or []
        return memory(spark, [{**r, "_seq": k} for k, r in enumerate(given)], None if given else "_seq bigint")
    host, _, port = p["addr"].rpartition(":")
    # Where rows land must be a folder that the executors see as well: given, or in the shared one if that is a mounted file system.
    folder = p.get("landing") or f"{shared_dir(spark).removeprefix('file://')}/ingest-{uuid.uuid4().hex}"
    if "://" in folder:
        raise ValueError("the shared folder is no mounted file system: the source needs `landing`")
    receiver = http_landing(folder, int(port), host or "127.0.0.1")
    more = {"maxFilesPerTrigger": PROFILES[spec.profile]["maxFilesPerTrigger"]} if spec.profile else {}
    if not p.get("schema"):
        return receiver.stream(spark, "value string", **more), receiver
    lines = read_files(spark, folder, "text", "value string", stream=True, **more)
    rows, rejects = parse_json(lines, "value", T.StructType.fromDDL(p["schema"]))
    return rows, receiver, rejects


def build(spark: SparkSession, job: Spec | str | dict, rows: list[dict] | None = None, bounded: int | None = None) -> Built:
    """Compiles a job. ``rows`` feed a memory source; ``bounded`` makes a generator a batch of so many rows."""
    spec = job if isinstance(job, Spec) else load(job)
    start, edges, made = _source(spark, spec, rows, bounded), spec.edges(), {}
    start, receiver, rejects = (*start, None, None)[:3] if isinstance(start, tuple) else (start, None, None)
    by_label = {s.label: s for s in spec.stages}
    for label in spec.order():
        before = [made[x] for x in edges if label in edges[x]]
        made[label] = _lower(by_label[label], ops.merge(*before) if before else start)
    return Built(spec, ops.merge(*[made[x] for x in edges if not edges[x]]), made, receiver, rejects)


def _lower(stage: Stage, df: DataFrame) -> DataFrame:
    if stage.parallelism > 1:
        keys = [stage.params["key"]] if stage.op in ("dedup", "session") else []
        df = df.repartition(stage.parallelism, *keys)
    if stage.op.startswith("ref:"):
        if stage.op[4:] not in _operators:
            raise ValueError(f"no operator is registered as {stage.op[4:]!r}")
        return _operators[stage.op[4:]](df, **stage.params)
    return LOWER[stage.op](df, stage.params)
