"""Expressions: "$path", constants, and functions by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Scope, literal
from .times import millis

Args = list[Column]
#: Functions of the expression language; each takes its arguments as columns.
FUNCTIONS: dict[str, Callable[[Args], Column]] = {
    # arithmetic
    "$add": lambda a: sum(a[1:], a[0]), "$subtract": lambda a: a[0] - a[1], "$multiply": lambda a: _product(a), "$divide": lambda a: F.try_divide(a[0], a[1]), "$mod": lambda a: F.try_mod(a[0], a[1]),
    "$abs": lambda a: F.abs(a[0]), "$ceil": lambda a: F.ceil(a[0]), "$floor": lambda a: F.floor(a[0]), "$round": lambda a: F.round(*a), "$sqrt": lambda a: F.sqrt(a[0]), "$pow": lambda a: F.pow(a[0], a[1]), "$ln": lambda a: F.ln(a[0]), "$exp": lambda a: F.exp(a[0]),
    # strings
    "$concat": lambda a: F.concat(*a), "$toUpper": lambda a: F.upper(a[0]), "$toLower": lambda a: F.lower(a[0]), "$strLenCP": lambda a: F.char_length(a[0]), "$strLenBytes": lambda a: F.octet_length(a[0]), "$substrCP": lambda a: F.substr(a[0], a[1] + 1, a[2]),
    "$trim": lambda a: F.trim(a[0]), "$ltrim": lambda a: F.ltrim(a[0]), "$rtrim": lambda a: F.rtrim(a[0]), "$split": lambda a: F.split_part(a[0], a[1], a[2]) if len(a) > 2 else F.split(a[0], F.concat(F.lit("\\Q"), a[1], F.lit("\\E"))), "$replaceAll": lambda a: F.replace(a[0], a[1], a[2]), "$regexFindAll": lambda a: F.regexp_extract_all(a[0], a[1], F.lit(0)),
    # conversion and conditions
    "$toInt": lambda a: a[0].try_cast("int"), "$toLong": lambda a: a[0].try_cast("long"), "$toDouble": lambda a: a[0].try_cast("double"), "$toString": lambda a: a[0].cast("string"), "$toBool": lambda a: a[0].try_cast("boolean"), "$toDate": lambda a: a[0].try_cast("timestamp"),
    "$ifNull": lambda a: F.coalesce(*a), "$nullIf": lambda a: F.nullif(a[0], a[1]), "$cond": lambda a: F.when(a[0], a[1]).otherwise(a[2]),
    "$eq": lambda a: a[0].eqNullSafe(a[1]), "$ne": lambda a: ~a[0].eqNullSafe(a[1]), "$gt": lambda a: F.coalesce(a[0] > a[1], F.lit(False)), "$gte": lambda a: F.coalesce(a[0] >= a[1], F.lit(False)), "$lt": lambda a: F.coalesce(a[0] < a[1], F.lit(False)), "$lte": lambda a: F.coalesce(a[0] <= a[1], F.lit(False)),
    "$and": lambda a: _fold(a, lambda x, y: x & y), "$or": lambda a: _fold(a, lambda x, y: x | y), "$not": lambda a: ~F.coalesce(a[0], F.lit(False)),
    # dates
    "$year": lambda a: F.year(a[0]), "$month": lambda a: F.month(a[0]), "$dayOfMonth": lambda a: F.dayofmonth(a[0]), "$dayOfWeek": lambda a: F.dayofweek(a[0]), "$hour": lambda a: F.hour(a[0]), "$minute": lambda a: F.minute(a[0]), "$second": lambda a: F.second(a[0]), "$millis": lambda a: millis(a[0]), "$now": lambda a: F.current_timestamp(),
    # arrays and documents
    "$size": lambda a: F.size(a[0]), "$arrayElemAt": lambda a: F.get(a[0], a[1]), "$inArray": lambda a: F.array_contains(a[1], a[0]), "$indexOfArray": lambda a: F.array_position(a[0], a[1]) - 1, "$sortArray": lambda a: F.sort_array(a[0]), "$distinctArray": lambda a: F.array_distinct(a[0]), "$concatArrays": lambda a: F.concat(*a), "$slice": lambda a: F.slice(a[0], a[1] + 1, a[2]),
    "$setUnion": lambda a: F.array_union(a[0], a[1]), "$setIntersection": lambda a: F.array_intersect(a[0], a[1]), "$setDifference": lambda a: F.array_except(a[0], a[1]), "$toJson": lambda a: F.to_json(a[0]), "$getJson": lambda a: F.get_json_object(a[0], "$"),
    # hashes, identifiers, vectors
    "$crc32": lambda a: F.crc32(a[0].cast("binary")), "$xxhash64": lambda a: F.xxhash64(*a), "$uuid": lambda a: F.uuid(), "$rand": lambda a: F.rand(),
    "$dot": lambda a: dot(a[0], a[1]), "$norm": lambda a: F.sqrt(dot(a[0], a[0])), "$cosine": lambda a: cosine(a[0], a[1]), "$l2": lambda a: l2(a[0], a[1]),
}


def _product(a: Args) -> Column:
    out = a[0]
    for x in a[1:]:
        out = out * x
    return out


def _fold(a: Args, f: Callable[[Column, Column], Column]) -> Column:
    out = F.coalesce(a[0], F.lit(False))
    for x in a[1:]:
        out = f(out, F.coalesce(x, F.lit(False)))
    return out


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length, -1 where their sizes differ."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(-1.0)).when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def expression(scope: Scope, e: Any) -> Column:
    """The column of an expression. "$path" is a field, {"$literal": x} x itself, {"$function": arguments} a call, an object of other
    keys a struct, everything else a constant. A path that is nowhere is null."""
    if isinstance(e, str) and e.startswith("$") and len(e) > 1:
        if e == "$$ROOT":
            return F.struct(*[scope.at(n).alias(n) for n in scope.kind.fieldNames()])
        field = scope.find(e.removeprefix("$$ROOT.").removeprefix("$"))
        return F.try_variant_get(field.column, field.inside, "string") if isinstance(field.kind, T.VariantType) and field.inside else field.column
    if isinstance(e, dict):
        if "$literal" in e:
            return literal(e["$literal"])
        if "$cond" in e and isinstance(e["$cond"], dict):
            e = {"$cond": [e["$cond"]["if"], e["$cond"]["then"], e["$cond"]["else"]]}
        if len(e) == 1 and (name := next(iter(e))).startswith("$"):
            if name not in FUNCTIONS:
                raise ValueError(f"unknown function {name}")
            args = e[name]
            return FUNCTIONS[name]([expression(scope, a) for a in (args if isinstance(args, list | tuple) else [args])])
        return F.struct(*[expression(scope, v).alias(k) for k, v in e.items()])
    if isinstance(e, list | tuple):
        return F.array(*[expression(scope, v) for v in e])
    return literal(e)
