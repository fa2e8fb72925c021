"""Metrics of streams, lineage of rows, and taps."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the latest figures of every running stream, and the durations of its last 1000 batches."""

    def __init__(self) -> None:
        self.figures: dict[str, dict] = {}
        self._names: dict[str, str] = {}  # by run
        self._times: dict[str, deque] = {}

    def onQueryStarted(self, event) -> None:
        name = self._names[str(event.runId)] = event.name or str(event.id)
        self.figures[name] = {"processed": 0, "errors": 0, "late": 0, "throughput": 0.0, "p50_ms": 0.0, "p99_ms": 0.0}

    def onQueryProgress(self, event) -> None:
        self.record(event.progress.name or str(event.progress.id), event.progress.numInputRows, event.progress.processedRowsPerSecond or 0.0, event.progress.batchDuration, sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators))

    def record(self, name: str, rows: int, rate: float, millis: float, late: int = 0) -> None:
        f = self.figures.setdefault(name, {"processed": 0, "errors": 0, "late": 0, "throughput": 0.0, "p50_ms": 0.0, "p99_ms": 0.0})
        times = self._times.setdefault(name, deque(maxlen=1000))
        times.append(millis)
        ordered = sorted(times)
        f["processed"] += rows
        f["late"] += late
        f["throughput"] = rate
        f["p50_ms"], f["p99_ms"] = ordered[len(ordered) // 2], ordered[min(len(ordered) - 1, int(len(ordered) * 0.99))]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self._names.pop(str(event.runId), str(event.id))
        if event.exception and name in self.figures:
            self.figures[name]["errors"] += 1


class Quarantine:
    """Rejected rows: the last ``keep`` of them and their number. Use ``sink`` as a ``foreachBatch`` of rejects; with a path they are also kept whole as files."""

    def __init__(self, keep: int = 1000, path: str | None = None) -> None:
        self.rows: deque = deque(maxlen=keep)
        self.total, self.path = 0, path

    def sink(self, df: DataFrame, batch: int) -> None:
        self.rows.extend(r.asDict() for r in df.limit(self.rows.maxlen).collect())
        self.total += df.count()
        if self.path:
            df.write.mode("overwrite").json(f"{self.path}/_batch={batch:020d}")


#: By figure: its name for Prometheus, kind, text and factor to base units.
METRICS = {
    "processed": ("rows_total", "counter", "Rows read.", 1.0), "errors": ("errors_total", "counter", "Runs that ended with an error.", 1.0), "late": ("late_rows_total", "counter", "Rows dropped as late.", 1.0),
    "throughput": ("rows_per_second", "gauge", "Rows a second in the last batch.", 1.0), "p50_ms": ("batch_seconds_p50", "gauge", "Median duration of the last batches.", 0.001),
    "p99_ms": ("batch_seconds_p99", "gauge", "99th percentile of the last batches' durations.", 0.001),
}


def prometheus(figures: dict[str, dict]) -> str:
    """The figures in Prometheus' text form: names with units, seconds, escaped labels."""
    label = lambda n: n.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    out = []
    for k, (name, kind, text, factor) in METRICS.items():
        out += [f"# HELP millrace_{name} {text}", f"# TYPE millrace_{name} {kind}", *(f'millrace_{name}{{stage="{label(n)}"}} {f[k] * factor:g}' for n, f in sorted(figures.items()))]
    return "\n".join(out) + "\n"


def stamp(df: DataFrame, order_by: list[str], prefix: str = "r") -> DataFrame:
    """Gives rows an id, ``_rid``, from the columns that tell them apart."""
    return df.withColumn("_rid", F.concat(F.lit(f"{prefix}-"), F.sha2(F.to_json(F.struct(*order_by)), 256).substr(1, 16)))


def with_parents(df: DataFrame, keys: list, *columns) -> DataFrame:
    """Aggregates rows that have ids and keeps the ids of each group's rows in ``_parents``; the group has an id of its own."""
    out = df.groupBy(*keys).agg(*columns, F.sort_array(F.collect_set("_rid")).alias("_parents"))
    return out.withColumn("_rid", F.concat(F.lit("g-"), F.sha2(F.to_json(F.struct("_parents")), 256).substr(1, 16)))


def ancestors(edges: DataFrame, start: DataFrame, depth: int = 32) -> DataFrame:
    """(_rid, ancestor) of the rows in ``start`` over (_rid, _parent) edges: one join a generation, until no more are found."""
    from ..operators.ordering import stored

    step = edges.select(F.col("_rid").alias("_c"), F.col("_parent").alias("_p"))
    found = frontier = stored(start.select("_rid").distinct().join(step, F.col("_rid") == F.col("_c")).select("_rid", F.col("_p").alias("ancestor")).distinct(), "ancestors")
    for _ in range(depth):
        frontier = stored(frontier.join(step, F.col("ancestor") == F.col("_c")).select("_rid", F.col("_p").alias("ancestor")).distinct().join(found, ["_rid", "ancestor"], "left_anti"), "ancestors")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise ValueError(f"more than {depth} generations")


def lineage_edges(*frames: DataFrame) -> DataFrame:
    """(_rid, _parent) of frames that have ``_parents``."""
    from functools import reduce

    parts = [f.select("_rid", F.explode("_parents").alias("_parent")) for f in frames]
    return reduce(DataFrame.unionByName, parts)


def export_lineage(path: str, *frames: DataFrame) -> None:
    """Writes every row that has an id as a line of JSON: its id, its parents and its own columns, sorted by id within a file."""
    for k, f in enumerate(frames):
        parents = F.col("_parents") if "_parents" in f.columns else F.array().cast("array<string>")
        own = [c for c in f.columns if c not in ("_rid", "_parents")]
        f.select(F.col("_rid").alias("id"), parents.alias("parents"), F.struct(*own).alias("data")).sortWithinPartitions("id").write.mode("append" if k else "overwrite").json(path)


def roots(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The ancestors that have no parent themselves."""
    return ancestors(edges, start).join(edges.select(F.col("_rid").alias("ancestor")).distinct(), "ancestor", "left_anti")


def tap(df: DataFrame, order_by: str, n: int = 20) -> DataFrame:
    """The last ``n`` rows."""
    return df.orderBy(F.desc(order_by)).limit(n)
