"""Update expressions as column transforms: {column: new value} over a row, applied where a filter holds."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import compile_filter, equal, sure
from .paths import Field, Scope, family, literal, of


class UpdateError(ValueError):
    """The update isn't valid for these columns."""


def set_path(df: DataFrame, path: str, value: Column | None) -> DataFrame:
    """df with a nested value set, or dropped for None. Structs on the way that are missing are made; what isn't a struct stays."""
    names = df.columns
    head, _, rest = path.partition(".")
    if path in names or not rest:
        return df.drop(path) if value is None else df.withColumn(path, value)
    if head not in names:
        return df if value is None else df.withColumn(head, _nest(rest.split("."), value))
    if not isinstance(df.schema[head].dataType, T.StructType):
        return df
    return df.withColumn(head, _with(F.col(f"`{head}`"), df.schema[head].dataType, rest.split("."), value))


def _nest(parts: list[str], value: Column) -> Column:
    for p in reversed(parts):
        value = F.struct(value.alias(p))
    return value


def _with(column: Column, kind: T.StructType, parts: list[str], value: Column | None) -> Column:
    head, rest = parts[0], parts[1:]
    if not rest:
        return column.dropFields(head) if value is None else column.withField(head, value)
    if head not in kind.fieldNames():
        return column if value is None else column.withField(head, _nest(rest, value))
    inner = kind[head].dataType
    return column.withField(head, _with(column.getField(head), inner, rest, value)) if isinstance(inner, T.StructType) else column


def _number(field: Field, path: str) -> None:
    if field.kind is not None and not isinstance(field.kind, T.NumericType):
        raise UpdateError(f"{path} isn't a number")


def _array(field: Field, path: str, op: str) -> bool:
    if field.kind is None or isinstance(field.kind, T.ArrayType):
        return True
    if op == "$push":
        raise UpdateError(f"{path} isn't an array")
    return False


def _each(value: Any) -> list:
    return list(value["$each"]) if isinstance(value, dict) and "$each" in value else [value]


def new_value(op: str, field: Field, value: Any, path: str) -> Column | None:
    """The value that an operator gives a field; None leaves it."""
    c, kind = field.column, field.kind
    if op in ("$set", "$setOnInsert"):
        return literal(value) if kind is None or value is None or not isinstance(kind, T.NumericType) else literal(value) if isinstance(value, float) and isinstance(kind, T.IntegralType) else literal(value).cast(kind)
    if op == "$inc":
        _number(field, path)
        if isinstance(kind, T.IntegralType) and isinstance(value, int):
            return F.coalesce(c.cast("long"), F.lit(0).cast("long")) + F.lit(value)  # wider, so that it doesn't overflow
        return F.coalesce(c, F.lit(0)) + F.lit(value)
    if op == "$mul":
        _number(field, path)
        return F.coalesce(c.cast("double"), F.lit(0.0)) * F.lit(float(value))
    if op in ("$min", "$max"):
        v = literal(value)
        if kind is not None and family(kind) not in ("number", "string"):
            return c
        return F.coalesce(F.least(c, v) if op == "$min" else F.greatest(c, v), v)
    if op == "$currentDate":
        return F.current_timestamp()
    if op == "$push" and _array(field, path, op):
        more = literal(_each(value))
        return F.concat(F.coalesce(c, F.array().cast(kind)), more) if kind is not None else more
    if op == "$addToSet" and _array(field, path, op):
        out = F.coalesce(c, F.array().cast(kind)) if kind is not None else None
        for v in _each(value):
            one = F.array(literal(v))
            if out is None:
                out = one
            else:
                out = F.when(_has(out, kind, v), out).otherwise(F.concat(out, one))
        return out
    if op in ("$pull", "$pullAll") and isinstance(kind, T.ArrayType):
        gone = [value] if op == "$pull" else list(value)
        return F.filter(c, lambda x: ~_any(x, kind.elementType, gone))
    if op == "$pop" and isinstance(kind, T.ArrayType):
        n = F.size(c)
        return F.when(n > 0, F.slice(c, 1, n - 1) if value >= 0 else F.slice(c, 2, n)).otherwise(c)
    if op == "$bit":
        for name, operand in value.items():
            c = {"and": c.bitwiseAND, "or": c.bitwiseOR, "xor": c.bitwiseXOR}[name](F.lit(operand))
        return c
    if op in ("$addToSet", "$pull", "$pullAll", "$pop"):
        return None
    raise UpdateError(f"unknown operator {op}")


def _has(array: Column, kind: T.DataType | None, v: Any) -> Column:
    return F.exists(array, lambda x: sure(equal(Field(x, kind.elementType), v) if isinstance(kind, T.ArrayType) else x == literal(v)))


def _any(x: Column, kind: T.DataType, values: list) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | sure(equal(Field(x, kind), v))
    return out


def apply_update(df: DataFrame, spec: dict, where: Any = None, upsert_names: bool = True, **options: Any) -> DataFrame:
    """df with the update's operators applied, in their order, to the rows that match; the other rows stay. Columns that an update adds
    are null elsewhere."""
    if not spec or any(not k.startswith("$") for k in spec):
        raise UpdateError("an update consists of operators")
    mark = "__hit"
    hit = sure(compile_filter(of(df), where, **options))
    df = df.withColumn(mark, hit)
    for op, fields in spec.items():
        for path, value in fields.items():
            scope = of(df)
            field = scope.find(path)
            if op == "$unset":
                df = _clear(df, path, mark)
            elif op == "$rename":
                df = _rename(df, path, value, mark)
            else:
                new = new_value(op, field, value, path)
                if new is not None:
                    old = field.column if field.kind is not None else F.lit(None)
                    df = set_path(df, path, F.when(F.col(mark), new).otherwise(old))
    return df.drop(mark)


def _clear(df: DataFrame, path: str, mark: str) -> DataFrame:
    field = of(df).find(path)
    return df if field.kind is None else set_path(df, path, F.when(~F.col(mark), field.column))


def _rename(df: DataFrame, path: str, to: str, mark: str) -> DataFrame:
    """Top-level names; a missing source leaves everything as it is."""
    if path not in df.columns:
        return df
    old = F.col(f"`{to}`") if to in df.columns else F.lit(None)
    moved = F.when(F.col(mark) & F.col(f"`{path}`").isNotNull(), F.col(f"`{path}`")).otherwise(old)
    return df.withColumn(to, moved).withColumn(path, F.when(~F.col(mark), F.col(f"`{path}`")))


def matched(scope: Scope, where: Any, **options: Any) -> Column:
    return sure(compile_filter(scope, where, **options))
