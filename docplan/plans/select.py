"""Runs parsed SELECT statements, and find options, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.accumulators import accumulate
from ..functions.filters import compile_filter
from ..functions.paths import of
from ..operators.joins import full_join
from ..operators.windows import order_by
from .sql import Select, SqlError


def unqualified(spec: Any, names: dict[str, str]) -> Any:
    """Paths without the alias before them, where it is one."""
    if isinstance(spec, dict):
        return {(k if k.startswith("$") else resolve(k, names)): unqualified(v, names) if k.startswith("$") else v for k, v in spec.items()}
    return [unqualified(x, names) for x in spec] if isinstance(spec, list) else spec


def resolve(path: str, names: dict[str, str]) -> str:
    """names: column of the joined rows by qualified path."""
    head, _, rest = path.partition(".")
    for n in (path, head):
        if n in names:
            return names[n] + path[len(n) :]
    for qualified, name in names.items():
        if rest and path.startswith(qualified + "."):
            return name + path[len(qualified) :]
    return path


def run_select(q: Select, table: Callable[[str], DataFrame]) -> DataFrame:
    df = table(q.table)
    names: dict[str, str] = {f"{q.alias}.{c}": c for c in df.columns}
    for j in q.joins:
        other = table(j.table)
        renamed = {c: c if c not in df.columns else f"{j.alias}_{c}" for c in other.columns}
        other = other.select(*[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
        more = {f"{j.alias}.{c}": n for c, n in renamed.items()}
        if j.how == "cross":
            df = df.crossJoin(other)
        else:
            sides = [j.left, j.right]
            inner = {**more, **{c: n for c, n in renamed.items() if c not in df.columns}}
            if resolve(j.left, names) in df.columns and resolve(j.right, inner) in other.columns:
                left, right = resolve(j.left, names), resolve(j.right, inner)
            elif resolve(j.right, names) in df.columns and resolve(j.left, inner) in other.columns:
                left, right = resolve(j.right, names), resolve(j.left, inner)
            else:
                raise SqlError(f"ON {' = '.join(map(str, sides))} doesn't join the two sides")
            df = full_join(df, other, left, right) if j.how == "full" else df.join(other, df[f"`{left}`"] == other[f"`{right}`"], j.how)
        names |= more
    scope = of(df)
    if q.where:
        df = df.where(compile_filter(scope, unqualified(q.where, names)))
    made = [i for i in q.items or [] if i.aggregate]
    if made or q.group:
        keys = [resolve(p, names) for p in q.group]
        for i in q.items or []:
            if not i.aggregate and resolve(i.path, names) not in keys:
                raise SqlError(f"{i.path} is neither grouped nor aggregated")
        aggs = [(F.count(scope.find(resolve(i.path, names)).column) if i.path else F.count(F.lit(1))).alias(i.name) if i.aggregate == "count" else accumulate(scope, f"${i.aggregate}", f"${resolve(i.path, names)}", strict_avg=True).alias(i.name) for i in made]
        labels = {resolve(i.path, names): i.name for i in q.items or [] if not i.aggregate}
        grouped = df.groupBy(*[scope.find(k).column.alias(labels.get(k, k.rpartition(".")[2])) for k in keys])
        df = grouped.agg(*aggs) if aggs else grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n")
        if q.having:
            df = df.where(compile_filter(of(df), unqualified(q.having, {p: labels.get(resolve(p, names), p.rpartition(".")[2]) for p in q.group})))
        order = [(p if p in df.columns else labels.get(resolve(p, names), p), d) for p, d in q.order]
        if order:
            df = df.orderBy(*order_by(of(df), order))
        if q.items:
            df = df.select(*[F.col(f"`{i.name}`") for i in q.items])
        if q.distinct:
            df = df.distinct()
    else:
        order = [(resolve(p, names), d) for p, d in q.order]
        if q.items and not q.distinct and order:  # names given in SELECT may be sorted by
            by_name = {i.name: resolve(i.path, names) for i in q.items}
            order = [(p if scope.find(p).kind is not None else by_name.get(p, p), d) for p, d in order]
        if order and not q.distinct:
            df = df.orderBy(*order_by(scope, order))
        if q.items:
            df = df.select(*[scope.find(resolve(i.path, names)).column.alias(i.name) for i in q.items])
        if q.distinct:
            df = df.distinct()
            if q.order:
                df = df.orderBy(*order_by(of(df), [(p.rpartition(".")[2] if p not in df.columns else p, d) for p, d in q.order]))
    if q.offset:
        df = df.offset(q.offset)
    return df if q.limit is None else df.limit(q.limit)


def find(df: DataFrame, filter: Any = None, projection: dict | None = None, sort: dict | None = None, skip: int | None = None, limit: int | None = None, **options: Any) -> DataFrame:  # noqa: A002
    """Filter, sort, skip, limit and projection, in this order. Projections take top-level names; including keeps `_id`."""
    if filter:
        df = df.where(compile_filter(of(df), filter, **options))
    if sort:
        df = df.orderBy(*order_by(of(df), list(sort.items())))
    if skip:
        df = df.offset(skip)
    if limit is not None:
        df = df.limit(limit)
    if projection:
        keep = [c for c in df.columns if projection.get(c) or c == "_id" and any(projection.values())]
        df = df.select(*[F.col(f"`{c}`") for c in keep]) if any(projection.values()) else df.drop(*projection)
    return df
