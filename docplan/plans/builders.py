"""Fluent builders of filters, updates, queries and pipelines. Query builders are immutable; the others return themselves."""

from __future__ import annotations

import copy
import json
from typing import Any

from pyspark.sql import DataFrame

#: Operators of where(field, op, value), by what they may be called. Fixed values.
OPS = {"=": "$eq", "==": "$eq", "eq": "$eq", "!=": "$ne", "<>": "$ne", "ne": "$ne", ">": "$gt", "gt": "$gt", ">=": "$gte", "gte": "$gte", "<": "$lt", "lt": "$lt", "<=": "$lte", "lte": "$lte", "in": "$in", "nin": "$nin", "exists": "$exists", "regex": "$regex", "all": "$all", "size": "$size", "elemMatch": "$elemMatch", "type": "$type"}


class FilterBuilder:
    """Conditions on fields; build() gives the filter. or_() and nor() take what is there so far as their first branch."""

    def __init__(self) -> None:
        self._spec: dict = {}

    def _put(self, field: str, op: str, value: Any) -> FilterBuilder:
        old = self._spec.get(field)
        self._spec[field] = (old if isinstance(old, dict) else {}) | {op: value}
        return self

    def eq(self, field: str, value: Any) -> FilterBuilder:
        return self._put(field, "$eq", value)

    def ne(self, field: str, value: Any) -> FilterBuilder:
        return self._put(field, "$ne", value)

    def gt(self, field: str, value: Any) -> FilterBuilder:
        return self._put(field, "$gt", value)

    def gte(self, field: str, value: Any) -> FilterBuilder:
        return self._put(field, "$gte", value)

    def lt(self, field: str, value: Any) -> FilterBuilder:
        return self._put(field, "$lt", value)

    def lte(self, field: str, value: Any) -> FilterBuilder:
        return self._put(field, "$lte", value)

    def in_(self, field: str, values: list) -> FilterBuilder:
        return self._put(field, "$in", list(values))

    def nin(self, field: str, values: list) -> FilterBuilder:
        return self._put(field, "$nin", list(values))

    def exists(self, field: str, there: bool = True) -> FilterBuilder:
        return self._put(field, "$exists", there)

    def type_(self, field: str, name: str) -> FilterBuilder:
        return self._put(field, "$type", name)

    def regex(self, field: str, pattern: str) -> FilterBuilder:
        return self._put(field, "$regex", pattern)

    def all_(self, field: str, values: list) -> FilterBuilder:
        return self._put(field, "$all", list(values))

    def size(self, field: str, n: int) -> FilterBuilder:
        return self._put(field, "$size", n)

    def elem_match(self, field: str, sub: Any) -> FilterBuilder:
        return self._put(field, "$elemMatch", sub)

    def _join(self, op: str, others: tuple) -> FilterBuilder:
        self._spec = {op: [self.build(), *(o.build() if isinstance(o, FilterBuilder) else o for o in others)]}
        return self

    def and_(self, *others: Any) -> FilterBuilder:
        return self._join("$and", others)

    def or_(self, *others: Any) -> FilterBuilder:
        return self._join("$or", others)

    def nor(self, *others: Any) -> FilterBuilder:
        return self._join("$nor", others)

    def build(self) -> dict:
        return copy.deepcopy(self._spec)


class UpdateBuilder:
    def __init__(self) -> None:
        self._spec: dict = {}

    def _put(self, op: str, field: str, value: Any) -> UpdateBuilder:
        self._spec.setdefault(op, {})[field] = value
        return self

    def set(self, field: str, value: Any) -> UpdateBuilder:
        return self._put("$set", field, value)

    def set_many(self, values: dict) -> UpdateBuilder:
        for k, v in values.items():
            self.set(k, v)
        return self

    def unset(self, *fields: str) -> UpdateBuilder:
        for f in fields:
            self._put("$unset", f, "")
        return self

    def inc(self, field: str, by: float = 1) -> UpdateBuilder:
        return self._put("$inc", field, by)

    def mul(self, field: str, by: float) -> UpdateBuilder:
        return self._put("$mul", field, by)

    def min(self, field: str, value: Any) -> UpdateBuilder:
        return self._put("$min", field, value)

    def max(self, field: str, value: Any) -> UpdateBuilder:
        return self._put("$max", field, value)

    def rename(self, field: str, to: str) -> UpdateBuilder:
        return self._put("$rename", field, to)

    def current_date(self, field: str) -> UpdateBuilder:
        return self._put("$currentDate", field, True)

    def push(self, field: str, value: Any) -> UpdateBuilder:
        return self._put("$push", field, value)

    def push_all(self, field: str, values: list) -> UpdateBuilder:
        return self._put("$push", field, {"$each": list(values)})

    def pull(self, field: str, value: Any) -> UpdateBuilder:
        return self._put("$pull", field, value)

    def pull_all(self, field: str, values: list) -> UpdateBuilder:
        return self._put("$pullAll", field, list(values))

    def add_to_set(self, field: str, value: Any) -> UpdateBuilder:
        return self._put("$addToSet", field, value)

    def pop(self, field: str, end: int = 1) -> UpdateBuilder:
        return self._put("$pop", field, end)

    def build(self) -> dict:
        return copy.deepcopy(self._spec)


class Query:
    """A query on a collection; each call gives a new one."""

    def __init__(self, collection: Any = None) -> None:
        self._collection, self._filter, self._options, self._hint = collection, {}, {}, {}

    def _new(self) -> Query:
        q = Query(self._collection)
        q._filter, q._options, q._hint = copy.deepcopy(self._filter), copy.deepcopy(self._options), dict(self._hint)
        return q

    def where(self, field: str, op: Any, *value: Any) -> Query:
        """where(field, value) or where(field, op, value). More conditions on a field add up; one after a plain value replaces it."""
        q = self._new()
        if not value:
            q._filter[field] = op
            return q
        name = OPS.get(op, op)
        if name not in OPS.values():
            raise ValueError(f"unknown operator {op}")
        old = q._filter.get(field)
        q._filter[field] = (old if isinstance(old, dict) else {}) | {name: value[0]}
        return q

    def where_in(self, field: str, values: list) -> Query:
        return self.where(field, "in", list(values))

    def where_not_in(self, field: str, values: list) -> Query:
        return self.where(field, "nin", list(values))

    def where_exists(self, field: str, there: bool = True) -> Query:
        return self.where(field, "exists", there)

    def where_null(self, field: str) -> Query:
        return self.where(field, "=", None)

    def where_not_null(self, field: str) -> Query:
        return self.where(field, "!=", None)

    def where_regex(self, field: str, pattern: str) -> Query:
        return self.where(field, "regex", pattern)

    def where_between(self, field: str, lo: Any, hi: Any) -> Query:
        return self.where(field, ">=", lo).where(field, "<=", hi)

    def where_all(self, field: str, values: list) -> Query:
        return self.where(field, "all", list(values))

    def where_size(self, field: str, n: int) -> Query:
        return self.where(field, "size", n)

    def where_elem_match(self, field: str, sub: Any) -> Query:
        return self.where(field, "elemMatch", sub)

    def _logical(self, op: str, specs: tuple) -> Query:
        q = self._new()
        q._filter = {"$and": [q._filter, {op: [s.to_mql() if isinstance(s, Query) else s for s in specs]}]} if q._filter else {op: [s.to_mql() if isinstance(s, Query) else s for s in specs]}
        return q

    def and_(self, *specs: Any) -> Query:
        return self._logical("$and", specs)

    def or_(self, *specs: Any) -> Query:
        return self._logical("$or", specs)

    def nor(self, *specs: Any) -> Query:
        return self._logical("$nor", specs)

    def not_(self, spec: Any) -> Query:
        q = self._new()
        negated = {"$not": spec.to_mql() if isinstance(spec, Query) else spec}
        q._filter = {"$and": [q._filter, negated]} if q._filter else negated
        return q

    def _option(self, **more: Any) -> Query:
        q = self._new()
        q._options |= more
        return q

    def project(self, spec: dict) -> Query:
        return self._option(projection=spec)

    def select(self, *fields: str) -> Query:
        return self._option(projection=dict.fromkeys(fields, 1))

    def exclude(self, *fields: str) -> Query:
        return self._option(projection=dict.fromkeys(fields, 0))

    def sort(self, spec: dict) -> Query:
        return self._option(sort=spec)

    def sort_by(self, field: str, direction: int | str = 1) -> Query:
        d = {"asc": 1, "desc": -1}.get(direction, direction)
        return self._option(sort=(self._options.get("sort") or {}) | {field: d})

    def limit(self, n: int) -> Query:
        return self._option(limit=n)

    def skip(self, n: int) -> Query:
        return self._option(skip=n)

    def page(self, n: int, size: int) -> Query:
        return self._option(skip=(n - 1) * size, limit=size)

    def hint(self, name: str) -> Query:
        """Noted, without effect: Spark plans from what tables hold."""
        q = self._new()
        q._hint["hint"] = name
        return q

    def timeout(self, ms: int) -> Query:
        """Noted, without effect."""
        q = self._new()
        q._hint["timeout"] = ms
        return q

    def explain_mode(self, mode: str) -> Query:
        q = self._new()
        q._hint["explain"] = mode
        return q

    def to_mql(self) -> dict:
        return copy.deepcopy(self._filter)

    @property
    def options(self) -> dict:
        return copy.deepcopy(self._options)

    def to_sql(self, name: str = "") -> str:
        """For reading only: the filter stands in it as JSON."""
        p = self._options.get("projection")
        cols = ", ".join(k for k, v in p.items() if v) if p else ""
        out = f"SELECT {cols or '*'} FROM {name or getattr(self._collection, 'name', '?')}"
        if self._filter:
            out += f" WHERE {json.dumps(self._filter, default=str)}"
        if self._options.get("sort"):
            out += " ORDER BY " + ", ".join(f"{k} {'ASC' if d > 0 else 'DESC'}" for k, d in self._options["sort"].items())
        for key, word in (("limit", "LIMIT"), ("skip", "OFFSET")):
            if self._options.get(key) is not None:
                out += f" {word} {self._options[key]}"
        return out

    # what needs a collection
    def execute(self) -> DataFrame:
        return self._collection.find(self._filter, **self._options)

    def first(self) -> Any:
        return self.limit(1).execute().first()

    def count(self) -> int:
        return self._collection.count(self._filter)

    def exists(self) -> bool:
        return bool(self._collection.find(self._filter).take(1))

    def stream(self, batch: int = 100) -> Any:
        """Rows one by one; the driver holds a partition at a time."""
        return self.execute().toLocalIterator()

    def explain(self) -> dict:
        return self._collection.explain(self._filter, **self._options)

    def match(self, spec: dict) -> Aggregate:
        return self._pipeline().match(spec)

    def group(self, spec: dict) -> Aggregate:
        return self._pipeline().group(spec)

    def _pipeline(self) -> Aggregate:
        a = Aggregate(self._collection)
        return a.match(self._filter) if self._filter else a

    def update_all(self, spec: dict | UpdateBuilder) -> int:
        return self._collection.update_many(self._filter, spec.build() if isinstance(spec, UpdateBuilder) else spec)

    def delete_all(self) -> int:
        return self._collection.delete_many(self._filter)


class Aggregate:
    """A pipeline, stage by stage."""

    def __init__(self, collection: Any = None) -> None:
        self._collection, self._stages = collection, []

    def add_stage(self, stage: dict) -> Aggregate:
        self._stages.append(stage)
        return self

    def match(self, spec: dict | FilterBuilder) -> Aggregate:
        return self.add_stage({"$match": spec.build() if isinstance(spec, FilterBuilder) else spec})

    def group(self, spec: dict) -> Aggregate:
        return self.add_stage({"$group": spec})

    def project(self, spec: dict) -> Aggregate:
        return self.add_stage({"$project": spec})

    def sort(self, spec: dict) -> Aggregate:
        return self.add_stage({"$sort": spec})

    def limit(self, n: int) -> Aggregate:
        return self.add_stage({"$limit": n})

    def skip(self, n: int) -> Aggregate:
        return self.add_stage({"$skip": n})

    def unwind(self, spec: Any) -> Aggregate:
        return self.add_stage({"$unwind": spec})

    def lookup(self, spec: dict) -> Aggregate:
        return self.add_stage({"$lookup": spec})

    def count(self, name: str = "count") -> Aggregate:
        return self.add_stage({"$count": name})

    def to_pipeline(self) -> list[dict]:
        return copy.deepcopy(self._stages)

    def execute(self) -> DataFrame:
        return self._collection.aggregate(self._stages)

    def to_list(self) -> list:
        return self.execute().collect()
