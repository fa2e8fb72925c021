"""Versioned schemas: a registry, and an adapter that adds, drops, renames and retypes columns."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of field types.
TYPES = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "any": T.VariantType()}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True
    default: object = None
    alias: str | None = None


@dataclass(frozen=True)
class Schema:
    id: str
    version: int
    fields: list[Field] = field(default_factory=list)


def to_struct(schema: Schema) -> T.StructType:
    return T.StructType([T.StructField(f.name, TYPES[f.type], f.nullable, {} if f.default is None else {"default": f.default}) for f in schema.fields])


class SchemaRegistry:
    """Linear versions by id. Subscribers hear of versions registered after they came, outside the lock."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._versions: dict[str, list[Schema]] = {}
        self._listeners: dict[str, list[Callable[[Schema], None]]] = {}

    def register(self, schema: Schema) -> None:
        with self._lock:
            known = self._versions.setdefault(schema.id, [])
            if schema.version != len(known) + 1:
                raise ValueError(f"schema {schema.id!r}: version {len(known) + 1} is next, not {schema.version}")
            known.append(schema)
            heard = list(self._listeners.get(schema.id, ()))
        for listener in heard:
            listener(schema)

    def subscribe(self, id: str, listener: Callable[[Schema], None]) -> None:
        with self._lock:
            self._listeners.setdefault(id, []).append(listener)

    def latest(self, id: str) -> Schema:
        with self._lock:
            if not self._versions.get(id):
                raise KeyError(id)
            return self._versions[id][-1]

    def version(self, id: str, version: int) -> Schema:
        with self._lock:
            known = self._versions.get(id, [])
            if not 1 <= version <= len(known):
                raise KeyError((id, version))
            return known[version - 1]

    def all_versions(self, id: str) -> list[Schema]:
        with self._lock:
            return list(self._versions.get(id, ()))

    def ids(self) -> list[str]:
        with self._lock:
            return sorted(self._versions)


def coerce(column: Column, kind: T.DataType, to: str) -> Column:
    """The column as another field type; null where it can't be."""
    if to == "int":
        if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
            return column.try_cast("bigint")
        return F.coalesce(column.try_cast("bigint"), column.try_cast("double").try_cast("bigint")) if isinstance(kind, T.StringType) else column.try_cast("bigint")
    if to == "float":
        return column.try_cast("double")
    if to == "string":
        return column.cast("string")
    if to == "bool":
        if isinstance(kind, T.NumericType):
            return column != 0
        if isinstance(kind, T.StringType):
            text = column
            return F.when(text.isin("1", "t", "T", "true", "TRUE", "True"), True).when(text.isin("0", "f", "F", "false", "FALSE", "False"), False)
        return column.try_cast("boolean")
    if to == "bytes":
        return column.cast("binary")
    return column


def adapt(df: DataFrame, schema: Schema, aliases: dict[str, str] | None = None, rescue: bool = False) -> DataFrame:
    """One projection to ``schema``: a column of the field's name, else of its alias, else the default; other columns are dropped.

    Values that can't be coerced become null; with ``rescue`` their text is kept by name in ``_rescued``.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    out, lost = [], []
    for f in schema.fields:
        old = f.alias or (aliases or {}).get(f.name)
        source = f.name if f.name in kinds else old if old in kinds else None
        if source is None:
            out.append(F.lit(f.default).cast(TYPES[f.type] if f.type != "any" else "string").alias(f.name))
            continue
        made = coerce(F.col(source), kinds[source], f.type)
        out.append(made.alias(f.name))
        if f.type not in ("string", "bytes", "any"):
            lost.append(F.when(made.isNull() & F.col(source).isNotNull(), F.struct(F.lit(f.name).alias("key"), F.col(source).cast("string").alias("value"))))
    if rescue:
        found = F.filter(F.array(*lost), lambda x: x.isNotNull()) if lost else F.array().cast("array<struct<key:string,value:string>>")
        out.append(F.map_from_entries(found).alias("_rescued"))
    return df.select(*out)
