"""Live schema changes: every micro-batch is adapted to the schema that is the latest when it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.schema import SchemaRegistry, adapt


def evolving_sink(registry: SchemaRegistry, id: str, sink: Callable[[DataFrame, int], None], payload: str | None = None, aliases: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``. With ``payload`` the rows' fields are in a JSON column of that name: fields that no version knew when the stream began are read as well."""

    def run(df: DataFrame, batch: int) -> None:
        schema = registry.latest(id)
        if payload:
            names = {f.name for f in schema.fields} | {f.alias for f in schema.fields if f.alias} | set((aliases or {}).values())
            # One aggregate tells which of the fields any row has.
            there = F.json_object_keys(F.col(payload))
            asked = sorted(names)
            found = df.agg(*[F.max(F.array_contains(there, x)).alias(f"f{k}") for k, x in enumerate(asked)]).first() if asked else ()
            known = [x for k, x in enumerate(asked) if found[k]]
            df = df.select(*[F.get_json_object(payload, f"$.{n}").alias(n) for n in known])
        sink(adapt(df, schema, aliases), batch)

    return run
