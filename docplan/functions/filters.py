"""Document filters as boolean columns.

Predicates are two-valued: what doesn't hold is false, never unknown. A compiled predicate may be NULL where it is false, which a
WHERE drops just so; only what negates it fills the NULLs. So conjuncts stay bare comparisons, which Parquet scans push down."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geo
from .paths import Field, Scope, family, family_of, inside, literal


class FilterError(ValueError):
    """The filter isn't valid."""


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def some(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


ORDER: dict[str, Callable[[Column, Column], Column]] = {
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
}
#: Type names as filters spell them.
TYPES: dict[str, tuple[type, ...]] = {
    "bool": (T.BooleanType,), "boolean": (T.BooleanType,), "int": (T.IntegerType, T.ShortType, T.ByteType), "int32": (T.IntegerType, T.ShortType, T.ByteType), "long": (T.LongType,), "int64": (T.LongType,),
    "double": (T.DoubleType, T.FloatType), "float64": (T.DoubleType, T.FloatType), "string": (T.StringType,), "array": (T.ArrayType,), "object": (T.StructType, T.MapType), "document": (T.StructType, T.MapType),
    "binData": (T.BinaryType,), "binary": (T.BinaryType,), "timestamp": (T.TimestampType, T.TimestampNTZType), "date": (T.DateType,), "decimal": (T.DecimalType,),
}


def equal(field: Field, value: Any) -> Column:
    """Null equals what is null or missing; values of different families are never equal."""
    if value is None:
        if isinstance(field.kind, T.VariantType):
            got = F.try_variant_get(field.column, field.inside or "$", "variant")
            return got.isNull() | F.is_variant_null(got)
        return field.column.isNull()
    column, kind = field.typed(value)
    if family(kind) in ("date", "time") and family_of(value) in ("date", "time") or family(kind) == family_of(value) != "document":
        return column == literal(value)
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return every([sure(equal(Field(column.getField(f.name), f.dataType), value.get(f.name))) for f in kind.fields]) & column.isNotNull() if set(value) <= set(kind.fieldNames()) else F.lit(False)
    return F.lit(False)


def ordered(op: str, field: Field, value: Any) -> Column:
    column, kind = field.typed(value)
    if family(kind) == family_of(value) and family_of(value) in ("number", "string", "bool", "time", "date") or {family(kind), family_of(value)} == {"date", "time"}:
        return ORDER[op](column, literal(value))
    return F.lit(False)


def among(field: Field, values: Any) -> Column:
    if not isinstance(values, list | tuple):
        return F.lit(False)
    whole = [v for v in values if v is not None]
    column, kind = field.typed(whole[0]) if whole else (field.column, field.kind)
    fit = [v for v in whole if family_of(v) == family(kind)]
    plain = column.isin(*fit) if fit and family(kind) not in ("array", "document") else some([equal(field, v) for v in whole])
    return plain | column.isNull() if None in values and isinstance(field.kind, T.VariantType) else plain


def of_type(field: Field, name: Any) -> Column:
    if isinstance(field.kind, T.VariantType):
        told = F.schema_of_variant(F.try_variant_get(field.column, field.inside or "$", "variant"))
        names = {"null": "VOID", "string": "STRING", "bool": "BOOLEAN", "boolean": "BOOLEAN", "long": "BIGINT", "int64": "BIGINT", "int": "BIGINT", "int32": "BIGINT"}
        if name in names:
            return told == names[name]
        return told.startswith({"double": "D", "float64": "D", "array": "ARRAY", "object": "OBJECT", "document": "OBJECT"}.get(name, "?"))
    if name == "null":
        return F.lit(False) if field.kind is not None else F.lit(False)
    return field.column.isNotNull() if isinstance(field.kind, TYPES.get(name, ())) else F.lit(False)


def holds_all(field: Field, values: Any) -> Column:
    if not isinstance(field.kind, T.ArrayType) or not isinstance(values, list | tuple):
        return F.lit(False)
    kind = field.kind.elementType

    def has(v: Any) -> Column:
        return F.exists(field.column, lambda x: sure(equal(Field(x, kind), v)))

    return every([field.column.isNotNull(), *map(has, values)])


def element(field: Field, sub: Any, options: dict) -> Column:
    if not isinstance(field.kind, T.ArrayType):
        return F.lit(False)
    kind = field.kind.elementType
    if isinstance(sub, dict) and sub and all(k.startswith("$") for k in sub):
        test = lambda x: operators(Field(x, kind), sub, options)
    elif isinstance(sub, dict) and isinstance(kind, T.StructType):
        test = lambda x: compile_filter(inside(x, kind), sub, **options)
    else:
        test = lambda x: equal(Field(x, kind), sub)
    return F.exists(field.column, lambda x: sure(test(x)))


def regex(field: Field, pattern: str, flags: str, options: dict) -> Column:
    column, kind = field.typed("")
    if family(kind) != "string":
        return F.lit(False)
    if options.get("regex_mode") == "contains":
        return column.contains(pattern)
    if set(flags) - set("imsx"):
        raise FilterError(f"unknown $options: {flags}")
    return column.rlike(f"(?{flags}){pattern}" if flags else pattern)


def operators(field: Field, spec: dict, options: dict) -> Column:
    parts = []
    for op, value in spec.items():
        if op == "$eq":
            parts.append(equal(field, value))
        elif op == "$ne":
            parts.append(~sure(equal(field, value)) if value is None or field.kind is None or isinstance(field.kind, T.StructType | T.ArrayType | T.VariantType) or family(field.kind) != family_of(value) else (field.column != literal(value)) | field.column.isNull())
        elif op in ORDER:
            parts.append(ordered(op, field, value))
        elif op == "$in":
            parts.append(among(field, value))
        elif op == "$nin":
            parts.append(~sure(among(field, value)))
        elif op == "$not":
            parts.append(~sure(operators(field, value if isinstance(value, dict) else {"$eq": value}, options)))
        elif op == "$exists":
            there = F.try_variant_get(field.column, field.inside or "$", "variant").isNotNull() if isinstance(field.kind, T.VariantType) else field.column.isNotNull()
            parts.append(there if not isinstance(value, bool) or value else ~there)
        elif op == "$type":
            parts.append(some([of_type(field, v) for v in value]) if isinstance(value, list) else of_type(field, value))
        elif op == "$all":
            parts.append(holds_all(field, value))
        elif op == "$elemMatch":
            parts.append(element(field, value, options))
        elif op == "$size":
            whole = isinstance(value, int) and not isinstance(value, bool)
            parts.append(F.size(field.column) == value if whole and isinstance(field.kind, T.ArrayType) else F.lit(False))
        elif op == "$regex":
            parts.append(regex(field, value, spec.get("$options", ""), options))
        elif op == "$options" and "$regex" in spec:
            continue
        elif op == "$geoWithin":
            parts.append(geo.within(field, value))
        elif op == "$geoIntersects":
            parts.append(geo.intersects(field, value))
        elif op in ("$near", "$geoNear"):
            parts.append(geo.near(field, value))
        elif op == "$nearSphere":
            parts.append(geo.near(field, (value if isinstance(value, dict) else {"coordinates": list(value)}) | {"spherical": True}))
        else:
            raise FilterError(f"unknown operator {op}")
    return every(parts)


def text_search(scope: Scope, query: Any) -> Column:
    """Any word is a part of any string column of the top level; no words match all."""
    words = str(query.get("$search", "") if isinstance(query, dict) else query).lower().split()
    if not words:
        return F.lit(True)
    strings = [F.lower(scope.at(f.name)) for f in scope.kind.fields if isinstance(f.dataType, T.StringType)]
    return some([sure(c.contains(w)) for c in strings for w in words])


def compare(scope: Scope, spec: dict) -> Column:
    """$expr: comparisons of paths and constants; two nulls are equal."""
    from .expressions import expression

    parts = []
    for op, args in spec.items():
        if op in ("$and", "$or"):
            parts.append((every if op == "$and" else some)([sure(compare(scope, a)) for a in args]))
            continue
        if op == "$not":
            parts.append(~sure(compare(scope, args[0] if isinstance(args, list) else args)))
            continue
        if not isinstance(args, list | tuple) or len(args) != 2 or op not in (*ORDER, "$eq", "$ne"):
            parts.append(F.lit(False))
            continue
        a, b = (expression(scope, x) for x in args)
        parts.append(a.eqNullSafe(b) if op == "$eq" else ~a.eqNullSafe(b) if op == "$ne" else ORDER[op](a, b))
    return every(parts)


def compile_filter(scope: Scope, spec: Any, **options: Any) -> Column:
    """A filter's predicate over a scope. None and {} match everything. Option regex_mode: "regex", or "contains"."""
    if spec is None:
        return F.lit(True)
    if not isinstance(spec, dict):
        raise FilterError("a filter is an object")
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, list | tuple):
                raise FilterError(f"{key} takes a list")
            each = [compile_filter(scope, v, **options) for v in value]
            parts.append(every(each) if key == "$and" else some(each) if key == "$or" else ~sure(some(each)))
        elif key == "$not":
            parts.append(~sure(compile_filter(scope, value, **options)))
        elif key == "$text":
            parts.append(text_search(scope, value))
        elif key == "$expr":
            parts.append(compare(scope, value))
        elif key == "$where":
            if not options.get("where"):
                raise FilterError("$where isn't enabled")
            parts.append(sure(F.expr(value) if isinstance(value, str) else value(scope)))
        elif key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        elif isinstance(value, dict) and (not value or next(iter(value)).startswith("$")):
            parts.append(operators(scope.find(key), value, options))
        elif isinstance(value, dict):
            raise FilterError(f"unknown operator {next(iter(value))}; an object is compared with $eq")
        else:
            parts.append(equal(scope.find(key), value))
    return every(parts)


def fields_of(spec: Any) -> list[str]:
    """The paths that a filter reads, in order; those of $expr too. What an index must cover, or a scan read."""
    found: dict[str, None] = {}

    def paths(e: Any) -> None:
        if isinstance(e, str) and e.startswith("$") and not e.startswith("$$"):
            found[e[1:]] = None
        for x in e.values() if isinstance(e, dict) else e if isinstance(e, list | tuple) else ():
            paths(x)

    def walk(f: Any) -> None:
        for key, value in f.items() if isinstance(f, dict) else ():
            if key in ("$and", "$or", "$nor"):
                for x in value:
                    walk(x)
            elif key == "$not":
                walk(value)
            elif key == "$expr":
                paths(value)
            elif not key.startswith("$"):
                found[key] = None

    walk(spec)
    return list(found)


# ---- the gate before filters from outside

#: What filters from outside may use. Fixed values.
ALLOWED = {"$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$and", "$or", "$not", "$nor", "$exists", "$type", "$all", "$elemMatch", "$size"}
FORBIDDEN_KEYS = {"__proto__", "constructor", "prototype"}


def check_filter(spec: Any, allow: set[str] | frozenset[str] = frozenset(), depth: int = 32, fields: set[str] | None = None) -> None:
    """Raises FilterError where a filter uses operators beyond the allowed ones, forbidden keys, deep nesting, patterns with many
    quantifiers, or fields that aren't listed."""
    if depth < 0:
        raise FilterError("the filter is nested too deeply")
    if isinstance(spec, list | tuple):
        for x in spec:
            check_filter(x, allow, depth - 1, fields)
    if not isinstance(spec, dict):
        return
    for key, value in spec.items():
        if key in FORBIDDEN_KEYS:
            raise FilterError(f"the key {key} is forbidden")
        if key == "$where" and "$where" not in allow:
            raise FilterError("$where isn't enabled")
        if key.startswith("$") and key not in ALLOWED | set(allow):
            raise FilterError(f"operator {key} isn't allowed")
        if key == "$regex" and len(re.findall(r"[*+?]|\{\d", str(value))) > 8:
            raise FilterError("the pattern has too many quantifiers")
        if fields is not None and not key.startswith("$") and key.split(".")[0] not in fields:
            raise FilterError(f"the field {key} isn't allowed")
        check_filter(value, allow, depth - 1, fields)


def check_document(doc: Any, depth: int = 128) -> None:
    """Documents from outside have no keys that look like operators."""
    if depth < 0:
        raise FilterError("the document is nested too deeply")
    for key, value in doc.items() if isinstance(doc, dict) else enumerate(doc) if isinstance(doc, list | tuple) else ():
        if isinstance(key, str) and (key.startswith("$") or key in FORBIDDEN_KEYS or len(key.encode()) > 255):
            raise FilterError(f"the key {key} is forbidden")
        check_document(value, depth - 1)
