"""The blocks that a declarative job can use, with their parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Param:
    name: str
    kind: str  # int, number, string, enum, map, list, any, duration
    required: bool = False
    default: object = None
    enum: tuple[str, ...] = ()


@dataclass(frozen=True)
class Block:
    type: str
    doc: str
    params: list[Param] = field(default_factory=list)
    parallel: bool = False  # whether `parallelism` may be above 1
    flushes: bool = False  # whether it emits what is open at the end of its input
    listed: bool = True


_CMP = ("gte", "lte", "eq")
_key, _agg = Param("key", "string", True), Param("agg", "string", default="count")
_ts, _late = Param("ts", "string", True), Param("lateness", "int", default=0)

SOURCES = {
    b.type: b
    for b in (
        Block("generator", "Rows made from field templates.", [Param("rate", "duration"), Param("fields", "map"), Param("rows", "int")]),
        Block("memory", "Rows that the caller supplies.", [Param("rows", "list")]),
        Block("http", "Rows posted to /ingest.", [Param("addr", "string", True)]),
    )
}
SINKS = {b.type: b for b in (Block("memory", "Rows kept for the caller."), Block("http", "Each row posted to a URL.", [Param("url", "string", True)]))}
OPERATORS = {
    b.type: b
    for b in (
        Block("filter", "Rows whose field compares as asked.", [Param("field", "string", True), Param("cmp", "enum", True, "gte", _CMP), Param("value", "any", True)], parallel=True),
        Block("map-set", "Sets a field to a constant.", [Param("field", "string", True), Param("value", "any", True)], parallel=True),
        Block("map-rename", "Renames a field if it is there.", [Param("from", "string", True), Param("to", "string", True)], parallel=True),
        Block("dedup", "Drops repeats of a key within a window.", [_key, Param("window", "duration", default="0s")], parallel=True),
        Block("tumbling", "Aggregates a number of rows.", [Param("size", "int", True), _agg], flushes=True),
        Block("timestamp", "Event time from a field.", [Param("field", "string", True)], parallel=True),
        Block("eventwindow", "Event-time tumbling windows.", [Param("size", "duration", True), Param("lateness", "duration", default="0s"), _agg], flushes=True),
        Block("session", "Sessions of a key.", [_key, Param("gap", "duration", True), _agg], parallel=True, flushes=True),
        Block("to-batch", "Rows as they are; `id` marks a side of a stream join.", [Param("size", "int", default=1024), Param("id", "string")]),
        Block("to-rows", "Rows as they are."),
        Block("vec-filter", "Compares a number.", [Param("field", "string", True), Param("cmp", "enum", True, "gte", _CMP), Param("value", "number", True)]),
        Block("vec-map", "Arithmetic with a constant.", [Param("field", "string", True), Param("arith", "enum", True, "add", ("add", "sub", "mul", "div")), Param("value", "number", True)]),
        Block("vec-join", "Joins a table given in the job.", [Param("build", "list", True), Param("build_key", "string"), Param("key", "string", True), Param("bring", "list", True), Param("left", "any"), Param("multi", "any")], listed=False),
        Block("vec-groupby", "Aggregates by key.", [_key, _agg], flushes=True),
        Block("vec-tumbling", "Event-time tumbling windows by key.", [_key, _ts, Param("size", "int", True), _late, _agg], flushes=True),
        Block("vec-sliding", "Event-time hopping windows by key.", [_key, _ts, Param("size", "int", True), Param("hop", "int", True), _late, _agg], flushes=True),
        Block("vec-session", "Sessions by key.", [_key, _ts, Param("gap", "int", True), _late, _agg], flushes=True),
        Block("vec-streamjoin", "Interval join of two marked sides.", [Param("left", "string", True), Param("right", "string", True), _key, _ts, Param("window", "int", True), _late]),
    )
}


def catalog() -> dict[str, list[dict]]:
    """The blocks that a form can build, by kind."""
    return {kind: [{k: v for k, v in asdict(b).items() if k != "listed"} for b in table.values() if b.listed] for kind, table in (("sources", SOURCES), ("operators", OPERATORS), ("sinks", SINKS))}
