"""Aggregation pipelines as DataFrame plans: one function for each stage, in a registry.

A pipeline keeps the order of its last $sort, which $first, $last, $push and the like of a following $group take."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.accumulators import BOUNDED, Order, accumulate, bounded
from ..functions.expressions import expression
from ..functions.filters import compile_filter
from ..functions.paths import family, of
from ..functions.updates import set_path
from . import windows


class PipelineError(ValueError):
    """The pipeline isn't valid."""


class State:
    """What a stage gets: the rows, their order, and how collections are read and written."""

    def __init__(self, df: DataFrame, tables: Callable[[str], DataFrame] | None = None, write: Callable[[str, DataFrame, str, list[str]], None] | None = None, tiebreak: list[str] | None = None, **options: Any) -> None:
        self.df, self.tables, self.write, self.options = df, tables, write, options
        self.order: Order = []
        self.tiebreak = tiebreak or []

    def table(self, name: str) -> DataFrame:
        if self.tables is None:
            raise PipelineError(f"there is no collection {name} here")
        return self.tables(name)

    def sub(self, df: DataFrame) -> State:
        new = State(df, self.tables, self.write, self.tiebreak, **self.options)
        new.order = list(self.order)
        return new


Stage = Callable[[State, Any], DataFrame]
STAGES: dict[str, Stage] = {}


def stage(*names: str) -> Callable[[Stage], Stage]:
    def enter(f: Stage) -> Stage:
        for n in names:
            STAGES[n] = f
        return f

    return enter


def run_pipeline(df: DataFrame, pipeline: list[dict], **context: Any) -> DataFrame:
    """The rows that a list of stages makes of df. context: tables, write, tiebreak, regex_mode, strict_avg."""
    return run_stages(State(df, **context), pipeline)


def run_stages(state: State, pipeline: list[dict]) -> DataFrame:
    if not isinstance(pipeline, list | tuple):
        raise PipelineError("a pipeline is a list of stages")
    for one in fuse(list(pipeline)):
        if not isinstance(one, dict) or len(one) != 1:
            raise PipelineError("a stage is an object with one key")
        (name, spec), *_ = one.items()
        if name not in STAGES:
            raise PipelineError(f"unknown stage {name}")
        state.df = STAGES[name](state, spec)
    return state.df


def fuse(pipeline: list[dict]) -> list[dict]:
    """Adjacent $match stages as one."""
    out: list[dict] = []
    for one in pipeline:
        if out and isinstance(one, dict) and list(one) == ["$match"] == list(out[-1]):
            out[-1] = {"$match": {"$and": [out[-1]["$match"] or {}, one["$match"] or {}]}}
        else:
            out.append(one)
    return out


def _filter_options(s: State) -> dict:
    return {k: v for k, v in s.options.items() if k == "regex_mode"}


@stage("$match")
def match(s: State, spec: Any) -> DataFrame:
    return s.df.where(compile_filter(of(s.df), spec, **_filter_options(s)))


def _flag(v: Any) -> bool | None:
    """Whether a projection keeps (True) or drops (False) a field; None if it computes it."""
    return v != 0 if isinstance(v, bool | int | float) else None


@stage("$project")
def project(s: State, spec: dict) -> DataFrame:
    """Keeps or drops fields, or computes them; `_id` stays unless it is dropped. Dotted names make structs of what they keep."""
    df, scope = s.df, of(s.df)
    kept = {k: v for k, v in spec.items() if _flag(v) is not False}
    if not kept:
        for k in spec:
            df = set_path(df, k, None) if scope.find(k).kind is not None else df
        return df
    columns: dict[str, Column | list[Column]] = {}
    if "_id" in df.columns and "_id" not in spec:
        columns["_id"] = F.col("_id")
    for k, v in kept.items():
        field = scope.find(k)
        if _flag(v) and field.kind is None:
            continue
        value = field.column if _flag(v) else expression(scope, v)
        head, _, rest = k.partition(".")
        if rest and k not in df.columns:
            columns.setdefault(head, []).append(value.alias(rest.replace(".", "_")))
        else:
            columns[k] = value
    return df.select(*[(F.struct(*c) if isinstance(c, list) else c).alias(k) for k, c in columns.items()])


@stage("$addFields", "$set")
def add_fields(s: State, spec: dict) -> DataFrame:
    """Later fields see earlier ones; dotted names go into structs."""
    df = s.df
    for k, v in spec.items():
        df = set_path(df, k, expression(of(df), v))
    return df


@stage("$unset")
def unset(s: State, spec: Any) -> DataFrame:
    df = s.df
    for k in [spec] if isinstance(spec, str) else spec:
        df = set_path(df, k, None) if of(df).find(k).kind is not None else df
    return df


@stage("$replaceRoot", "$replaceWith")
def replace_root(s: State, spec: Any) -> DataFrame:
    """Rows whose new root isn't a document are dropped."""
    e = spec["newRoot"] if isinstance(spec, dict) and "newRoot" in spec else spec
    if not e:
        return s.df
    root = s.df.select(expression(of(s.df), e).alias("root")).where("root IS NOT NULL")
    if not isinstance(root.schema["root"].dataType, T.StructType):
        return s.df.limit(0)
    return root.select("root.*")


@stage("$sort")
def sort(s: State, spec: dict | list) -> DataFrame:
    s.order = list(spec.items()) if isinstance(spec, dict) else [tuple(x) for x in spec]
    return s.df.orderBy(*windows.order_by(of(s.df), s.order))


def _count(n: Any, name: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise PipelineError(f"{name} takes a whole number from 0 on")
    return n


@stage("$limit")
def limit(s: State, n: Any) -> DataFrame:
    return s.df.limit(_count(n, "$limit"))


@stage("$skip")
def skip(s: State, n: Any) -> DataFrame:
    return s.df.offset(_count(n, "$skip"))


@stage("$sample")
def sample(s: State, spec: dict) -> DataFrame:
    return s.df.orderBy(F.rand(spec.get("seed"))).limit(_count(spec["size"], "$sample"))


@stage("$unwind")
def unwind(s: State, spec: Any) -> DataFrame:
    """A row for each element; what isn't an array passes once. preserveNullAndEmptyArrays keeps rows without elements."""
    spec = {"path": spec} if isinstance(spec, str) else spec
    path, index, keep = spec["path"].removeprefix("$"), spec.get("includeArrayIndex"), spec.get("preserveNullAndEmptyArrays", False)
    field = of(s.df).find(path)
    if not isinstance(field.kind, T.ArrayType):
        df = s.df if keep else s.df.where(field.column.isNotNull())
        return df.withColumn(index, F.lit(None).cast("long")) if index else df
    if index or "." in path:
        both = (F.posexplode_outer if keep else F.posexplode)(field.column).alias("__at", "__value")
        df = s.df.select("*", both)
        df = set_path(df, path, F.col("__value"))
        return (df.withColumn(index, F.col("__at").cast("long")) if index else df).drop("__at", "__value")
    one = (F.explode_outer if keep else F.explode)(field.column)
    return s.df.select(*[one.alias(c) if c == path else F.col(f"`{c}`") for c in s.df.columns])


@stage("$count")
def count(s: State, name: Any) -> DataFrame:
    return s.df.agg(F.count(F.lit(1)).alias(name if isinstance(name, str) and name else "count"))


def _group_key(s: State, e: Any) -> Column | None:
    """None for one group of all rows."""
    if isinstance(e, dict) and e or isinstance(e, str) and e.startswith("$"):
        return expression(of(s.df), e)
    return None


def _accumulators(s: State, spec: dict) -> list[Column]:
    out = []
    for name, call in spec.items():
        if not isinstance(call, dict) or len(call) != 1:
            raise PipelineError(f"{name} takes one accumulator")
        (op, arg), *_ = call.items()
        out.append(accumulate(of(s.df), op, arg, s.order, s.options.get("strict_avg", False)).alias(name))
    return out


@stage("$group")
def group(s: State, spec: dict) -> DataFrame:
    """Without a key there is one group with `_id` null; no rows make no group."""
    if "_id" not in spec:
        raise PipelineError("$group needs _id")
    key = _group_key(s, spec["_id"])
    calls = {k: v for k, v in spec.items() if k not in ("_id", ROLL)}
    first = {k: v for k, v in calls.items() if isinstance(v, dict) and len(v) == 1 and next(iter(v)) in BOUNDED}
    if first and ROLL not in spec:
        return _group_first(s, key, calls, first)
    aggs = _accumulators(s, calls)
    s.order = []
    if ROLL in spec:
        return _group_rolled(s, spec, aggs)
    if key is None:
        return s.df.agg(F.count(F.lit(1)).alias("__n"), *aggs).where("__n > 0").withColumn("__n", F.lit(None).cast("string")).withColumnRenamed("__n", "_id")
    return s.df.groupBy(key.alias("_id")).agg(*aggs) if aggs else s.df.select(key.alias("_id")).distinct()


#: In $group: "rollup" or "cube" over the fields of a compound `_id`; totals have null there.
ROLL = "$grouping"


def _group_rolled(s: State, spec: dict, aggs: list[Column]) -> DataFrame:
    if not isinstance(spec["_id"], dict) or spec[ROLL] not in ("rollup", "cube"):
        raise PipelineError("$grouping is rollup or cube, over the fields of _id")
    keys = {k: expression(of(s.df), e) for k, e in spec["_id"].items()}
    grouped = getattr(s.df, spec[ROLL])(*[c.alias(k) for k, c in keys.items()])
    out = grouped.agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
    return out.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("_id"), *[F.col(f"`{c}`") for c in out.columns[len(keys) :] if c != "__n"])


def _group_first(s: State, key: Column | None, calls: dict, first: dict) -> DataFrame:
    """Groups whose accumulators take the first n of an order. The rows of a group are numbered by sorts, which spill: those of each
    part of it first, and then the first n of all parts, so neither a task's memory nor an array holds a large group."""
    df, scope = s.df, of(s.df)
    df = df.withColumn("__key", F.lit(0) if key is None else key).withColumn("__salt", F.spark_partition_id() % 64)
    aggs = []
    for name, call in calls.items():
        (op, arg), *_ = call.items()
        found = bounded(scope, op, arg, s.order) if name in first else None
        if found is None:
            aggs.append(accumulate(scope, op, arg, s.order, s.options.get("strict_avg", False)).alias(name))
            continue
        value, order, n = found
        order, at = windows.order_by(scope, order) if order else [value.asc() if op == "$minN" else value.desc()], f"__at{len(aggs)}"
        there = value.isNotNull() if op in ("$minN", "$maxN") else F.lit(True)
        df = df.withColumn(at, F.row_number().over(Window.partitionBy("__key", "__salt", there).orderBy(*order)))
        df = df.withColumn(at, F.when((F.col(at) <= n) & there, -1).otherwise(F.col("__salt")))
        df = df.withColumn(at, F.when(F.col(at) < 0, F.row_number().over(Window.partitionBy("__key", at).orderBy(*order))))
        some = F.array_sort(F.collect_list(F.when(F.col(at) <= n, F.struct(F.col(at).alias("at"), value.alias("value")))))
        values = F.transform(some, lambda x: x["value"])
        values = F.reverse(values) if op == "$lastN" else values
        aggs.append((values if op.endswith("N") else F.get(values, F.lit(0))).alias(name))
    s.order = []
    if key is None:
        return df.agg(F.count(F.lit(1)).alias("__n"), *aggs).where("__n > 0").withColumn("__n", F.lit(None).cast("string")).withColumnRenamed("__n", "_id")
    return df.groupBy(F.col("__key").alias("_id")).agg(*aggs)


@stage("$sortByCount")
def sort_by_count(s: State, e: Any) -> DataFrame:
    df = s.df.groupBy(expression(of(s.df), e).alias("_id")).agg(F.count(F.lit(1)).alias("count"))
    s.order = [("count", -1), ("_id", 1)]
    return df.orderBy(F.desc("count"), F.asc_nulls_last("_id"))


def _buckets(s: State, value: Column, edges: list, default: Any, output: dict | None, ids: list | None = None) -> DataFrame:
    ids = edges[:-1] if ids is None else ids
    text = default is not None and isinstance(default, str) or default is None
    case = None
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        test = (value >= F.lit(a)) & (value < F.lit(b))
        name = F.lit(str(ids[i]) if text else ids[i])
        case = F.when(test, name) if case is None else case.when(test, name)
    case = case.otherwise(F.lit("Other" if default is None else default))
    aggs = _accumulators(s, output or {"count": {"$count": {}}})
    return s.df.groupBy(case.alias("_id")).agg(*aggs)


@stage("$bucket")
def bucket(s: State, spec: dict) -> DataFrame:
    """Half-open ranges between boundaries; everything else goes to `default` ("Other"). Where the default is text, so are all names."""
    if len(spec.get("boundaries", ())) < 2:
        raise PipelineError("$bucket needs two boundaries at least")
    scope = of(s.df)
    value = expression(scope, spec["groupBy"])
    if isinstance(spec["groupBy"], str) and family(scope.find(spec["groupBy"][1:]).kind) != "number":
        value = F.lit(None).cast("double")
    return _buckets(s, value, list(spec["boundaries"]), spec.get("default"), spec.get("output"))


@stage("$bucketAuto")
def bucket_auto(s: State, spec: dict) -> DataFrame:
    """About equally filled ranges. Their edges are approximate percentiles, a bounded sketch, so no task sees all rows."""
    n = _count(spec["buckets"], "$bucketAuto")
    value = expression(of(s.df), spec["groupBy"])
    points = s.df.agg(F.percentile_approx(value, [k / n for k in range(n + 1)], 1_000_000).alias("p")).first()["p"]
    if not points:
        return s.df.limit(0).groupBy(value.alias("_id")).agg(*_accumulators(s, spec.get("output") or {"count": {"$count": {}}}))
    edges = sorted(set(points))
    case = F.lit(edges[0])
    for e in edges[1:-1]:
        case = F.when(value >= F.lit(e), F.lit(e)).otherwise(case)
    return s.df.where(value.isNotNull()).groupBy(case.alias("_id")).agg(*_accumulators(s, spec.get("output") or {"count": {"$count": {}}}))


@stage("$facet")
def facet(s: State, spec: dict) -> DataFrame:
    """One row with an array for each sub-pipeline. Facets of counts alone come from their own scans, which Spark shares."""
    parts = []
    for name, pipeline in spec.items():
        sub = s.sub(s.df)
        rows = run_stages(sub, pipeline)
        fields = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        if sub.order and all(p in rows.columns for p, _ in sub.order):
            from ..functions.accumulators import listed

            every = listed(of(rows), fields, sub.order)
        else:
            every = F.sort_array(F.collect_list(fields)) if not any(isinstance(f.dataType, T.MapType | T.VariantType) for f in rows.schema) else F.collect_list(fields)
        parts.append(rows.agg(every.alias(name)))
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # each has one row


@stage("$lookup")
def lookup(s: State, spec: dict) -> DataFrame:
    """A left join whose matches are nested in an array. A sub-pipeline runs over the other side before."""
    other = s.table(spec["from"])
    if spec.get("pipeline"):
        other = run_stages(s.sub(other), spec["pipeline"])
    here, there, name = of(s.df).find(spec["localField"]), of(other).find(spec["foreignField"]), spec.get("as", "joined")
    rows = F.struct(*[F.col(f"`{c}`") for c in other.columns])
    flat = not any(isinstance(f.dataType, T.MapType | T.VariantType) for f in other.schema)
    many = F.collect_list(rows)
    # only rows that some row here asks for are gathered
    keys = s.df.select(here.column.alias("__asked")).where("__asked IS NOT NULL").distinct()
    other = other.join(keys, there.column == F.col("__asked"), "left_semi")
    nested = other.groupBy(there.column.alias("__key")).agg((F.sort_array(many) if flat else many).alias("__rows"))
    out = s.df.join(nested, here.column == nested["__key"], "left").drop("__key")
    return set_path(out, name, F.coalesce(F.col("__rows"), F.array().cast(nested.schema["__rows"].dataType))).drop("__rows")


def reliable(df: DataFrame) -> DataFrame:
    """df without its lineage, in the session's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master.split("[")[0] != "local":
                raise PipelineError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="docplan-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


@stage("$graphLookup")
def graph_lookup(s: State, spec: dict) -> DataFrame:
    """{from, startWith, connectFromField, connectToField, as, maxDepth}: what each row reaches, in an array of {node, depth}, by joins
    level by level, each pair at its least depth. Without maxDepth it goes on until nothing new is reached."""
    edges = s.table(spec["from"]).select(F.col(spec["connectToField"]).alias("node"), F.col(spec["connectFromField"]).alias("next"))
    start = s.df.select(expression(of(s.df), spec["startWith"]).alias("start")).where("start IS NOT NULL").distinct()
    seen = start.join(edges.select("node").distinct(), F.col("start") == F.col("node")).select("start", "node", F.lit(0).alias("depth"))
    edge, depth, most = seen, 0, spec.get("maxDepth")
    while most is None or depth < most:
        depth += 1
        step = edge.join(edges, "node").where("next IS NOT NULL").select("start", F.col("next").alias("node")).distinct()
        step = step.join(edges.select("node").distinct(), "node", "left_semi").join(seen, ["start", "node"], "left_anti")
        edge = step.select("start", "node", F.lit(depth).alias("depth"))
        if most is None:
            edge = reliable(edge)
            if not edge.take(1):
                break
        seen = seen.union(edge)
    nested = seen.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("node", "depth"))).alias("__rows"))
    out = s.df.join(nested, expression(of(s.df), spec["startWith"]) == nested["start"], "left").drop("start")
    return out.withColumn(spec["as"], F.coalesce("__rows", F.array().cast(nested.schema["__rows"].dataType))).drop("__rows")


@stage("$unionWith")
def union_with(s: State, spec: Any) -> DataFrame:
    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = s.table(spec["coll"])
    return s.df.unionByName(run_stages(s.sub(other), spec.get("pipeline", [])), allowMissingColumns=True)


@stage("$setWindowFields")
def set_window_fields(s: State, spec: dict) -> DataFrame:
    return windows.set_window_fields(s.df, spec)


@stage("$densify")
def densify(s: State, spec: dict) -> DataFrame:
    return windows.densify(s.df, spec)


@stage("$fill")
def fill(s: State, spec: dict) -> DataFrame:
    return windows.fill(s.df, spec)


@stage("$out")
def out(s: State, spec: Any) -> DataFrame:
    """Replaces a collection and passes the rows on."""
    name = spec if isinstance(spec, str) else spec["coll"]
    if s.write is None:
        raise PipelineError("there is nowhere to write to here")
    s.write(name, s.df, "overwrite", [])
    return s.table(name)


@stage("$merge")
def merge(s: State, spec: Any) -> DataFrame:
    """Rows into a collection by `on` (`_id`): {into, on, whenMatched: replace, merge, keepExisting or fail, whenNotMatched: insert, discard or fail}."""
    spec = {"into": spec} if isinstance(spec, str) else spec
    on = spec.get("on", "_id")
    on = [on] if isinstance(on, str) else list(on)
    if s.write is None:
        raise PipelineError("there is nowhere to write to here")
    s.write(spec["into"], s.df, f"merge:{spec.get('whenMatched', 'replace')}:{spec.get('whenNotMatched', 'insert')}", on)
    return s.table(spec["into"])


def tables_in(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
