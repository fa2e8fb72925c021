"""Declarative jobs: the text form, its dataclasses, and what makes a job valid."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .catalog import OPERATORS, SINKS, SOURCES, Param

#: Profiles and what they mean for Spark. Sidecar: small, prompt batches; dedicated: large ones.
PROFILES = {
    "sidecar": {"spark.sql.shuffle.partitions": "8", "maxFilesPerTrigger": "16", "trigger": "5 milliseconds"},
    "dedicated": {"spark.sql.shuffle.partitions": "200", "maxFilesPerTrigger": "512", "trigger": "0 seconds"},
}


def use_profile(spark, name: str) -> dict[str, str]:
    """Sets a profile's Spark options on the session; the rest, for readers and triggers, is returned."""
    if name not in PROFILES:
        raise JobError(f"unknown profile {name!r}")
    for k, v in PROFILES[name].items():
        if k.startswith("spark."):
            spark.conf.set(k, v)
    return {k: v for k, v in PROFILES[name].items() if not k.startswith("spark.")}


class JobError(ValueError):
    """The job's text or graph is not valid."""


@dataclass
class Source:
    type: str
    params: dict = field(default_factory=dict)


@dataclass
class Sink:
    type: str
    params: dict = field(default_factory=dict)


@dataclass
class Stage:
    label: str
    op: str
    next: list[str] = field(default_factory=list)
    parallelism: int = 1
    params: dict = field(default_factory=dict)


@dataclass
class Spec:
    name: str
    source: Source
    stages: list[Stage]
    sink: Sink
    profile: str | None = None

    def edges(self) -> dict[str, list[str]]:
        """Each stage's successors: as written if any stage says ``next``, else the one below."""
        if any(s.next for s in self.stages):
            return {s.label: list(s.next) for s in self.stages}
        return {a.label: [b.label] for a, b in zip(self.stages, self.stages[1:], strict=False)} | ({self.stages[-1].label: []} if self.stages else {})

    def order(self) -> list[str]:
        """Labels, predecessors first."""
        edges = self.edges()
        waits = {x: sum(x in e for e in edges.values()) for x in edges}
        ready, out = [x for x in edges if not waits[x]], []
        while ready:
            at = ready.pop(0)
            out.append(at)
            for x in edges[at]:
                waits[x] -= 1
                if not waits[x]:
                    ready.append(x)
        if len(out) < len(edges):
            raise JobError(f"the stages form a cycle: {', '.join(sorted(set(edges) - set(out)))}")
        return out


def parse(text: str | dict) -> Spec:
    """A spec from YAML (or JSON, which is YAML) or from the parsed mapping."""
    if isinstance(text, str):
        try:
            import yaml
        except ImportError:
            data = json.loads(text)
        else:
            data = yaml.safe_load(text)
    else:
        data = text
    if not isinstance(data, dict):
        raise JobError("a job is a mapping")
    extra = set(data) - {"name", "profile", "source", "stages", "sink"}
    if extra:
        raise JobError(f"unknown keys: {', '.join(sorted(extra))}")

    def end(kind: type, key: str):
        x = data.get(key)
        if not isinstance(x, dict) or not x.get("type"):
            raise JobError(f"{key} needs a type")
        return kind(x["type"], {k: v for k, v in x.items() if k != "type"})

    stages = []
    for x in data.get("stages") or []:
        if not isinstance(x, dict):
            raise JobError("a stage is a mapping")
        following = x.get("next") or []
        stages.append(Stage(str(x.get("label") or ""), str(x.get("op") or ""), [following] if isinstance(following, str) else list(following), x.get("parallelism", 1), {k: v for k, v in x.items() if k not in ("label", "op", "next", "parallelism")}))
    return Spec(str(data.get("name") or ""), end(Source, "source"), stages, end(Sink, "sink"), data.get("profile"))


def dump(spec: Spec) -> str:
    """The spec as JSON, which ``parse`` reads."""
    out = {"name": spec.name, "source": {"type": spec.source.type, **spec.source.params}, "stages": [{"label": s.label, "op": s.op, **({"next": s.next} if s.next else {}), **({"parallelism": s.parallelism} if s.parallelism != 1 else {}), **s.params} for s in spec.stages], "sink": {"type": spec.sink.type, **spec.sink.params}}
    return json.dumps(out | ({"profile": spec.profile} if spec.profile else {}), indent=2)


def _typed(where: str, params: dict, known: list[Param]) -> None:
    from ..functions.specs import seconds

    for p in known:
        value = params.get(p.name)
        if value is None:
            if p.required:
                raise JobError(f"{where}: {p.name} is needed")
            continue
        number = isinstance(value, int | float) and not isinstance(value, bool)
        ok = {"int": number and float(value).is_integer(), "number": number, "string": isinstance(value, str | int | float), "enum": value in p.enum, "map": isinstance(value, dict), "list": isinstance(value, list), "any": True, "duration": isinstance(value, str | int | float)}[p.kind]
        if ok and p.kind == "duration":
            try:
                seconds(value)
            except ValueError:
                ok = False
        if not ok:
            raise JobError(f"{where}: {p.name} is no {p.kind}: {value!r}")


def validate(spec: Spec) -> Spec:
    """Checks structure, graph, blocks, parameters and parallelism; raises JobError."""
    if not spec.name:
        raise JobError("a job needs a name")
    if spec.profile is not None and spec.profile not in PROFILES:
        raise JobError(f"unknown profile {spec.profile!r}")
    if not spec.stages:
        raise JobError("a job needs a stage")
    labels = [s.label for s in spec.stages]
    if not all(labels):
        raise JobError("a stage needs a label")
    if len(set(labels)) < len(labels):
        raise JobError(f"labels repeat: {', '.join(sorted({x for x in labels if labels.count(x) > 1}))}")
    for s in spec.stages:
        for x in s.next:
            if x not in labels:
                raise JobError(f"{s.label}: no stage {x!r} to go on to")
    spec.order()
    for kind, part, table in (("source", spec.source, SOURCES), ("sink", spec.sink, SINKS)):
        if not part.type.startswith("ref:"):
            if part.type not in table:
                raise JobError(f"unknown {kind} {part.type!r}")
            _typed(kind, part.params, table[part.type].params)
    for s in spec.stages:
        ref = s.op.startswith("ref:")
        if not ref and s.op not in OPERATORS:
            raise JobError(f"{s.label}: unknown operator {s.op!r}")
        if not isinstance(s.parallelism, int) or s.parallelism < 0:
            raise JobError(f"{s.label}: parallelism is no count: {s.parallelism!r}")
        if s.parallelism > 1 and (ref or not OPERATORS[s.op].parallel):
            raise JobError(f"{s.label}: {s.op} can't be run in parallel")
        if not ref:
            params = dict(s.params)
            if s.op == "filter" and "cmp" not in params:  # the older form: the comparison is the key
                for old in ("gte", "lte", "eq"):
                    if old in params:
                        params |= {"cmp": old, "value": params[old]}
            _typed(s.label, {**{p.name: p.default for p in OPERATORS[s.op].params if p.default is not None}, **params}, OPERATORS[s.op].params)
            if s.op == "filter" and params.get("cmp", "gte") != "eq" and not isinstance(params.get("value"), int | float):
                raise JobError(f"{s.label}: value is no number: {params.get('value')!r}")
            if s.op == "vec-map" and params.get("arith") == "div" and params.get("value") == 0:
                raise JobError(f"{s.label}: division by zero")
            for p in ("size", "hop"):
                if s.op != "eventwindow" and isinstance(params.get(p), int | float) and params[p] < 1:
                    raise JobError(f"{s.label}: {p} is less than 1")
    return spec


def load(text: str | dict) -> Spec:
    return validate(parse(text))
