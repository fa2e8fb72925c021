"""A job's graph, from its source to its sink, as Mermaid, DOT or JSON."""

from __future__ import annotations

import json

from .spec import Spec


def edges(spec: Spec) -> list[tuple[str, str]]:
    following = spec.edges()
    reached = {x for e in following.values() for x in e}
    out = [("source", s.label) for s in spec.stages if s.label not in reached]
    for s in spec.stages:
        out += [(s.label, x) for x in following[s.label] or ["sink"]]
    return out


def render(spec: Spec, format: str = "mermaid") -> str:
    found = edges(spec)
    if format == "mermaid":
        name = lambda x: f"{''.join('_' if c in '-. ' else c for c in x)}[{x}]"
        return "graph LR\n" + "".join(f"  {name(a)} --> {name(b)}\n" for a, b in found)
    if format == "dot":
        quoted = json.dumps
        return f"digraph {quoted(spec.name)} {{\n  rankdir=LR;\n" + "".join(f"  {quoted(a)} -> {quoted(b)};\n" for a, b in found) + "}\n"
    if format == "json":
        return json.dumps({"name": spec.name, "edges": [{"from": a, "to": b} for a, b in found]}, indent=2)
    raise ValueError(f"unknown format {format!r}")
