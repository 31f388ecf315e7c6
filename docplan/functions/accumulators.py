"""Accumulators of groups, buckets and windows.

Those that depend on order take the order that the pipeline has; without one, ties and first places are as Spark meets them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import expression
from .paths import Scope, literal

#: An order: paths with 1 or -1.
Order = list[tuple[str, int]]


def numeric(scope: Scope, arg: Any) -> Column:
    """A number, with 0 for what is missing or none."""
    if isinstance(arg, str) and arg.startswith("$"):
        field = scope.find(arg[1:])
        if isinstance(field.kind, T.VariantType):
            return F.coalesce(F.try_variant_get(field.column, field.inside or "$", "double"), F.lit(0.0))
        return F.coalesce(field.column, F.lit(0).cast(field.kind)) if isinstance(field.kind, T.NumericType) else F.lit(0)
    if isinstance(arg, dict):
        return F.coalesce(expression(scope, arg), F.lit(0))
    if isinstance(arg, bool) or not isinstance(arg, int | float):
        raise ValueError(f"{arg!r} isn't a number")
    return literal(arg)


def key(scope: Scope, order: Order) -> tuple[Column, bool] | None:
    """One value that sorts as the order does, and whether it descends; none where the directions are mixed."""
    if not order or len({d for _, d in order}) > 1:
        return None
    parts = [(i, scope.find(p).column) for i, (p, _) in enumerate(order)]  # what is missing is last when ascending, first when descending
    return F.struct(*[x for i, c in parts for x in (c.isNull().alias(f"n{i}"), c.alias(f"k{i}"))]), order[0][1] < 0


def listed(scope: Scope, value: Column, order: Order) -> Column:
    """All values in order, nulls too."""
    if not order:
        return F.collect_list(F.struct(value.alias("v"))).getField("v")
    pairs = F.collect_list(F.struct(*[scope.find(p).column.alias(f"k{i}") for i, (p, _) in enumerate(order)], value.alias("v")))

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, (_, d) in reversed(list(enumerate(order))):
            x, y = a.getField(f"k{i}"), b.getField(f"k{i}")
            out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), d).when(y.isNull(), -d).when(x < y, -d).when(x > y, d).otherwise(out)
        return out

    return F.array_sort(pairs, compare).getField("v")


#: Accumulators that plugins enter.
CUSTOM: dict[str, Any] = {}
#: Accumulators of the first n of an order, which needn't gather a group.
BOUNDED = ("$minN", "$maxN", "$firstN", "$lastN", "$top", "$bottom", "$topN", "$bottomN", "$first", "$last")


def bounded(scope: Scope, name: str, arg: Any, order: Order) -> tuple[Column, Order, int] | None:
    """The value, the order to take the first n of (none: of the values themselves), and n; None where there is no order to take them
    by, or a plain aggregate does it."""
    if name in ("$minN", "$maxN"):
        return expression(scope, arg["input"]), [], arg["n"]
    if name in ("$top", "$bottom", "$topN", "$bottomN"):
        own = list(arg["sortBy"].items())
        return expression(scope, arg["output"]), own if name.startswith("$top") else [(p, -d) for p, d in own], arg["n"] if name.endswith("N") else 1
    if not order or name in ("$first", "$last") and len({d for _, d in order}) == 1:
        return None
    back = order if name in ("$first", "$firstN") else [(p, -d) for p, d in order]
    return expression(scope, arg["input"] if name.endswith("N") else arg), list(back), arg["n"] if name.endswith("N") else 1


def accumulate(scope: Scope, name: str, arg: Any, order: Order = (), strict_avg: bool = False) -> Column:
    order = list(order)
    if name == "$sum":
        return F.sum(numeric(scope, arg))
    if name == "$avg":
        return F.avg(expression(scope, arg)) if strict_avg else F.sum(numeric(scope, arg)).cast("double") / F.count(F.lit(1))
    if name == "$count":
        return F.count(F.lit(1))
    if name == "$min":
        return F.min(expression(scope, arg))
    if name == "$max":
        return F.max(expression(scope, arg))
    if name in ("$first", "$last"):
        value, by = expression(scope, arg), key(scope, order)
        if by:
            return (F.min_by if (name == "$first") != by[1] else F.max_by)(value, by[0])
        if order:
            every = listed(scope, value, order)
            return F.get(every, F.lit(0)) if name == "$first" else F.get(every, F.size(every) - 1)
        return F.first(value) if name == "$first" else F.last(value)
    if name == "$push":
        return F.filter(listed(scope, expression(scope, arg), order), lambda x: x.isNotNull())
    if name == "$addToSet":
        every = F.filter(listed(scope, expression(scope, arg), order), lambda x: x.isNotNull()) if order else F.sort_array(F.collect_set(expression(scope, arg)))
        return F.array_distinct(every)
    if name in ("$stdDevPop", "$stdDevSamp"):
        return (F.stddev_pop if name == "$stdDevPop" else F.stddev_samp)(expression(scope, arg))
    if name in ("$varPop", "$varSamp"):
        return (F.var_pop if name == "$varPop" else F.var_samp)(expression(scope, arg))
    if name in ("$minN", "$maxN", "$firstN", "$lastN"):
        n, value = arg["n"], expression(scope, arg["input"])
        if name in ("$minN", "$maxN"):
            return F.slice(F.sort_array(F.collect_list(value), asc=name == "$minN"), 1, n)
        every = listed(scope, value, order)
        return F.slice(every, 1, n) if name == "$firstN" else F.slice(every, F.greatest(F.lit(1), F.size(every) - n + 1), n)
    if name in ("$top", "$bottom", "$topN", "$bottomN"):
        own = list(arg["sortBy"].items())
        every = listed(scope, expression(scope, arg["output"]), own if name.startswith("$top") else [(p, -d) for p, d in own])
        return F.slice(every, 1, arg["n"]) if name.endswith("N") else F.get(every, F.lit(0))
    if name == "$mergeObjects":
        return F.map_from_entries(F.array_sort(F.flatten(F.collect_list(F.map_entries(expression(scope, arg))))))
    if name in ("$median", "$percentile"):
        e = expression(scope, arg["input"] if isinstance(arg, dict) else arg)
        return F.percentile(e, F.lit(0.5)) if name == "$median" else F.percentile(e, literal([float(p) for p in arg["p"]]))
    if name in ("$boolAnd", "$boolOr", "$bitAnd", "$bitOr"):
        return {"$boolAnd": F.bool_and, "$boolOr": F.bool_or, "$bitAnd": F.bit_and, "$bitOr": F.bit_or}[name](expression(scope, arg))
    if name == "$countDistinct":
        return F.count_distinct(expression(scope, arg))
    if name == "$approxCountDistinct":
        return F.approx_count_distinct(expression(scope, arg))
    if name == "$stringAgg":
        return F.array_join(F.filter(listed(scope, expression(scope, arg["input"]), order), lambda x: x.isNotNull()), arg.get("separator", ","))
    if name == "$accumulator":  # {init, merge, finalize, args}: columns by functions, over the gathered values
        from .plugins import folded

        return folded(arg["init"], arg["merge"], arg.get("finalize"), arg.get("kind"))(expression(scope, arg["args"][0] if isinstance(arg["args"], list) else arg["args"]))
    if name in CUSTOM:
        return CUSTOM[name](expression(scope, arg))
    if name == "$histogram":
        return F.histogram_numeric(expression(scope, arg["input"]), F.lit(arg["bins"]))
    raise ValueError(f"unknown accumulator {name}")
