"""Windows over partitions of documents: computed fields, densifying and filling."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.accumulators import accumulate
from ..functions.expressions import expression
from ..functions.paths import Scope, family, of
from ..functions.times import micros, seconds


def order_by(scope: Scope, order: list[tuple[str, int]]) -> list[Column]:
    """What is missing comes last when ascending, first when descending; VARIANT values go by type and then by value, null first."""
    out = []
    for p, d in order:
        field = scope.find(p)
        if isinstance(field.kind, T.VariantType):
            c = value_order(F.try_variant_get(field.column, field.inside or "$", "variant"))
            out.append(c.asc() if d > 0 else c.desc())
        else:
            out.append(field.column.asc_nulls_last() if d > 0 else field.column.desc_nulls_first())
    return out


def value_order(c: Column) -> Column:
    """A key that sorts VARIANT values of all types: null and missing, numbers, texts, documents, arrays, booleans, times. Within a type
    by value; documents and arrays by their JSON."""
    kind = F.upper(F.schema_of_variant(c))
    number, text = F.try_variant_get(c, "$", "double"), F.try_variant_get(c, "$", "string")
    of = [
        (kind.isNull() | (kind == "VOID"), 1), (kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), 2), (kind == "STRING", 3),
        (kind.startswith("OBJECT"), 4), (kind.startswith("ARRAY"), 5), (kind == "BOOLEAN", 6),
    ]
    rank = F.lit(7)
    for test, n in reversed(of):
        rank = F.when(test, n).otherwise(rank)
    as_text = F.when(rank.isin(4, 5), F.to_json(c)).when(rank.isin(3, 6, 7), text)
    return F.struct(rank.alias("rank"), F.when(rank == 2, number).alias("number"), as_text.alias("text"))


def partition(scope: Scope, by: Any) -> list[Column]:
    if by is None:
        return []
    if isinstance(by, dict) and not any(k.startswith("$") for k in by):
        return [expression(scope, e) for e in by.values()]
    return [expression(scope, e) for e in by] if isinstance(by, list) else [expression(scope, by)]


def _bound(value: Any, scale: int = 1) -> int:
    if value == "unbounded":
        raise ValueError
    return 0 if value == "current" else value * scale


SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def framed(w: WindowSpec, scope: Scope, order: list, frame: dict | None, parts: list[Column]) -> WindowSpec:
    """documents: rows; range: values of the one order field, with a unit for times."""
    if not frame:
        return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = "documents" if "documents" in frame else "range"
    lo, hi = frame[kind]
    scale = SECONDS[frame["unit"]] if "unit" in frame else 1
    a = Window.unboundedPreceding if lo == "unbounded" else _bound(lo, scale)
    b = Window.unboundedFollowing if hi == "unbounded" else _bound(hi, scale)
    if kind == "documents":
        return w.rowsBetween(a, b)
    field = scope.find(order[0][0])
    value = seconds(field.column) if family(field.kind) == "time" else field.column
    return Window.partitionBy(*parts).orderBy(value.asc() if order[0][1] > 0 else value.desc()).rangeBetween(a, b)


def set_window_fields(df: DataFrame, spec: dict) -> DataFrame:
    """{partitionBy, sortBy, output: {field: {$function: argument, window}}}. Ranks, $shift, $ntile and all accumulators."""
    scope = of(df)
    parts = partition(scope, spec.get("partitionBy"))
    order = list(spec.get("sortBy", {}).items())
    base = Window.partitionBy(*parts)
    sorted_ = base.orderBy(*order_by(scope, order)) if order else base
    new: dict[str, Column] = {}
    for name, call in spec["output"].items():
        (op, arg), frame = next((k, v) for k, v in call.items() if k != "window"), call.get("window")
        if op in ("$rank", "$denseRank", "$documentNumber", "$rowNumber", "$percentRank", "$cumeDist"):
            f = {"$rank": F.rank, "$denseRank": F.dense_rank, "$documentNumber": F.row_number, "$rowNumber": F.row_number, "$percentRank": F.percent_rank, "$cumeDist": F.cume_dist}[op]
            new[name] = f().over(sorted_)
        elif op == "$ntile":
            new[name] = F.ntile(arg).over(sorted_)
        elif op == "$shift":
            new[name] = F.lag(expression(scope, arg["output"]), -arg["by"], arg.get("default")).over(sorted_)
        elif op in ("$first", "$last"):
            new[name] = (F.first if op == "$first" else F.last)(expression(scope, arg)).over(framed(sorted_, scope, order, frame, parts))
        elif op == "$avg":  # as in groups, over all rows of the frame
            w = framed(sorted_, scope, order, frame, parts)
            new[name] = accumulate(scope, "$sum", arg).over(w).cast("double") / F.count(F.lit(1)).over(w)
        else:
            new[name] = accumulate(scope, op, arg).over(framed(sorted_, scope, order, frame, parts))
    return df.withColumns(new)


def densify(df: DataFrame, spec: dict) -> DataFrame:
    """{field, partitionByFields, range: {step, unit, bounds}}: rows for the steps that are missing. Bounds: "full" (of all rows),
    "partition", or a pair, the upper one excluded."""
    name, by, range_ = spec["field"], list(spec.get("partitionByFields", [])), spec["range"]
    kind = df.schema[name].dataType
    time = family(kind) in ("time", "date")
    step = F.expr(f"INTERVAL {int(range_['step'])} {range_['unit']}") if time else F.lit(range_["step"]).cast(kind)
    bounds = range_.get("bounds", "full")
    ends = df.groupBy(*by).agg(F.min(name).alias("__lo"), F.max(name).alias("__hi"))
    if bounds == "full":
        all_ = df.agg(F.min(name).alias("__lo"), F.max(name).alias("__hi"))
        ends = df.select(*by).distinct().join(F.broadcast(all_)) if by else all_  # one row
    elif bounds != "partition":
        lo, hi = (F.lit(b).cast(kind) for b in bounds)
        ends = (df.select(*by).distinct() if by else df.sparkSession.range(1).select()).withColumns({"__lo": lo, "__hi": hi - step})
    steps = ends.where("__lo IS NOT NULL").select(*by, F.explode(F.sequence("__lo", "__hi", step)).alias(name))
    missing = steps.join(df.select(*by, name).distinct(), [*by, name], "left_anti")
    return df.unionByName(missing, allowMissingColumns=True)


def fill(df: DataFrame, spec: dict) -> DataFrame:
    """{partitionBy or partitionByFields, sortBy, output: {field: {value} or {method: "locf" or "linear"}}} for nulls."""
    scope = of(df)
    parts = [F.col(f"`{c}`") for c in spec["partitionByFields"]] if "partitionByFields" in spec else partition(scope, spec.get("partitionBy"))
    order = list(spec.get("sortBy", {}).items())
    w = Window.partitionBy(*parts).orderBy(*order_by(scope, order))
    before, behind = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    new: dict[str, Column] = {}
    for name, how in spec["output"].items():
        c = F.col(f"`{name}`")
        if "value" in how:
            new[name] = F.coalesce(c, expression(scope, how["value"]))
        elif how["method"] == "locf":
            new[name] = F.coalesce(c, F.last(c, ignorenulls=True).over(before))
        elif how["method"] == "linear":
            field = scope.find(order[0][0])
            x = micros(field.column) if family(field.kind) == "time" else field.column
            at = F.when(c.isNotNull(), x)
            x0, y0 = F.last(at, True).over(before), F.last(c, True).over(before)
            x1, y1 = F.first(at, True).over(behind), F.first(c, True).over(behind)
            new[name] = F.coalesce(c.cast("double"), y0 + (y1 - y0) * (x - x0) / F.nullif(x1 - x0, F.lit(0)))
        else:
            raise ValueError(f"unknown method {how['method']}")
    return df.withColumns(new)

