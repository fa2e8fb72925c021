"""A fluent builder: sources, operators and sinks that compile to one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame

from . import operators as ops
from .sources import collect_rows, discard, write_ndjson

Transform = Callable[[DataFrame], DataFrame]


class Stream:
    """``Stream("name").source(df).filter(...).map(...).run()``. The first error is kept and raised by ``build``; the last source and sink count."""

    def __init__(self, name: str = "stream") -> None:
        self.name, self._source, self._sink, self._error = name, None, None, None
        self.steps: list[tuple[str, Transform]] = []

    def source(self, df: DataFrame) -> Stream:
        self._source = df
        return self

    def sink(self, fn: Callable[[DataFrame], object]) -> Stream:
        self._sink = fn
        return self

    def _add(self, kind: str, fn: Transform | None, label: str | None = None, check: str | None = None) -> Stream:
        if check and not self._error:
            self._error = ValueError(f"{kind}: {check}")
        label = label or f"{kind}-{sum(x.startswith(f'{kind}-') for x, _ in self.steps) + 1}"
        if any(x == label for x, _ in self.steps) and not self._error:
            self._error = ValueError(f"label {label!r} repeats")
        self.steps.append((label, fn))
        return self

    def map(self, label: str | None = None, **columns: Column) -> Stream:
        return self._add("map", lambda d: ops.map_columns(d, **columns), label)

    def filter(self, condition: Column | str, label: str | None = None) -> Stream:
        return self._add("filter", lambda d: d.where(condition), label)

    def flat_map(self, array: Column, name: str, label: str | None = None) -> Stream:
        return self._add("flatmap", lambda d: ops.flat_map(d, array, name), label)

    def tumbling(self, size: int, spec, order_by: list[str], label: str | None = None) -> Stream:
        return self._add("tumbling", lambda d: ops.count_tumbling(d, size, spec, order_by), label, None if size >= 1 else "size is less than 1")

    def sliding(self, size: int, step: int, spec, order_by: list[str], label: str | None = None) -> Stream:
        return self._add("sliding", lambda d: ops.count_sliding(d, size, step, spec, order_by), label, None if size >= step >= 1 else "size >= step >= 1 is needed")

    def deduplicate(self, key: str, ts: str, window, order_by: list[str], label: str | None = None) -> Stream:
        return self._add("dedup", lambda d: ops.deduplicate(d, key, ts, window, order_by), label)

    def apply(self, fn: Transform, label: str | None = None) -> Stream:
        return self._add("apply", fn, label)

    def branch(self, *chains: Callable[[Stream], Stream], label: str | None = None) -> Stream:
        """Each chain is a function that adds steps to an empty stream; one that adds none passes rows on."""
        made = [[fn for _, fn in c(Stream()).steps] for c in chains]
        return self._add("branch", lambda d: ops.branch(d, *made), label, None if len(chains) > 1 else "two chains are needed")

    def build(self) -> DataFrame:
        if self._error:
            raise self._error
        if self._source is None:
            raise ValueError("no source")
        return reduce(lambda d, step: step[1](d), self.steps, self._source)

    def run(self):
        return (self._sink or collect_rows)(self.build())

    def to_file(self, path: str) -> Stream:
        return self.sink(lambda d: write_ndjson(d, path))

    def discard(self) -> Stream:
        return self.sink(discard)


def run_all(*streams: Stream) -> list:
    """Runs independent streams side by side; the first failure is raised when all have ended."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max(1, len(streams))) as pool:
        return [f.result() for f in [pool.submit(s.run) for s in streams]]
