"""Dotted paths over a schema. A path names nested fields, array places (`tags.0`) and keys of maps; in VARIANT columns it goes on
inside the value. A path that the schema doesn't have is missing everywhere, which in typed columns is the same as null."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from decimal import Decimal
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Field(NamedTuple):
    """What a path leads to. kind is None where there is nothing."""

    column: Column
    kind: T.DataType | None
    inside: str = ""  # JSON path inside a VARIANT

    def typed(self, value: Any) -> tuple[Column, T.DataType | None]:
        """The column as a value of this kind is compared with: VARIANTs are read as the value's family."""
        if not isinstance(self.kind, T.VariantType):
            return self.column, self.kind
        name, kind = {"number": ("double", T.DoubleType()), "string": ("string", T.StringType()), "bool": ("boolean", T.BooleanType())}.get(family_of(value) or "", ("variant", self.kind))
        return F.try_variant_get(self.column, self.inside or "$", name), kind


class Scope(NamedTuple):
    """Where paths start: a row's columns, or one value such as an array's element."""

    kind: T.StructType
    at: Callable[[str], Column]

    def find(self, path: str) -> Field:
        names = {f.name: f.dataType for f in self.kind.fields}
        if path in names:  # also names that have dots themselves
            return Field(self.at(path), names[path])
        head, _, rest = path.partition(".")
        if head not in names:
            return Field(F.lit(None), None)
        return step(Field(self.at(head), names[head]), rest.split("."))


def of(df: Any) -> Scope:
    return Scope(df.schema, lambda name: F.col(f"`{name}`"))


def inside(column: Column, kind: T.StructType) -> Scope:
    return Scope(kind, lambda name: column.getField(name))


def step(field: Field, parts: list[str]) -> Field:
    for k, part in enumerate(parts):
        column, kind = field.column, field.kind
        if isinstance(kind, T.StructType) and part in kind.fieldNames():
            field = Field(column.getField(part), kind[part].dataType)
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            field = Field(F.get(column, F.lit(int(part))), kind.elementType)
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            field = Field(F.try_element_at(column, F.lit(part)), kind.valueType)
        elif isinstance(kind, T.VariantType):
            path = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts[k:])
            return Field(column, kind, path)
        else:
            return Field(F.lit(None), None)
    return field


def family(kind: T.DataType | None) -> str | None:
    """Values are ordered within families only."""
    if isinstance(kind, T.NumericType):
        return "number"
    return {T.StringType: "string", T.BooleanType: "bool", T.TimestampType: "time", T.TimestampNTZType: "time", T.DateType: "date", T.BinaryType: "binary", T.ArrayType: "array", T.StructType: "document", T.MapType: "document", T.VariantType: "variant"}.get(type(kind))


def family_of(value: Any) -> str | None:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int | float | Decimal):
        return "number"
    for kind, name in ((str, "string"), (datetime.datetime, "time"), (datetime.date, "date"), (bytes, "binary"), (list | tuple, "array"), (dict, "document")):
        if isinstance(value, kind):
            return name
    return None


def literal(value: Any) -> Column:
    """A constant; lists and dicts become arrays and structs."""
    if isinstance(value, list | tuple):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    return F.lit(value)
