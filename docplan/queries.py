"""Queries over the test tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import FUNCTIONS, expression
from .functions.filters import compile_filter
from .functions import geo
from .functions.geo import meters
from .functions.paths import of
from .functions.times import micros, millis
from .functions.updates import apply_update
from .operators import kv, relations, search, stores, timeseries, vectors, versions
from .operators.pipeline import run_pipeline, tables_in
from .plans import ansi
from .plans.builders import Aggregate, FilterBuilder, Query, UpdateBuilder
from .plans.select import find
from .streaming import changes

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def enter(f: Run) -> Run:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return enter


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pipeline(spark: SparkSession, d: str, name: str, stages: list[dict], **context: Any) -> DataFrame:
    return run_pipeline(table(spark, d, name), stages, tables=tables_in(spark, d), **context)


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# ---- filters: each over lineitem, orders, customer, part or events, whole tables

_keys = ["l_orderkey", "l_linenumber"]


def _lineitem_filter(name: str, spec: dict, where: str) -> None:
    query(name, f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {where}")(lambda s, d: find(table(s, d, "lineitem"), spec).select(*_keys))


for _name, _spec, _where in (
    ("filter_eq", {"l_returnflag": "R"}, "l_returnflag = 'R'"),
    ("filter_ne", {"l_linestatus": {"$ne": "O"}}, "l_linestatus <> 'O'"),
    ("filter_gt", {"l_quantity": {"$gt": 45}}, "l_quantity > 45"),
    ("filter_gte_lt", {"l_quantity": {"$gte": 10, "$lt": 12}}, "l_quantity >= 10 AND l_quantity < 12"),
    ("filter_lte", {"l_discount": {"$lte": 0.01}}, "l_discount <= 0.01"),
    ("filter_in", {"l_linenumber": {"$in": [1, 7]}}, "l_linenumber IN (1, 7)"),
    ("filter_nin", {"l_linenumber": {"$nin": [1, 2, 3]}}, "l_linenumber NOT IN (1, 2, 3)"),
    ("filter_and", {"$and": [{"l_returnflag": "N"}, {"l_quantity": {"$gt": 30}}]}, "l_returnflag = 'N' AND l_quantity > 30"),
    ("filter_or", {"$or": [{"l_returnflag": "A"}, {"l_quantity": {"$lt": 3}}]}, "l_returnflag = 'A' OR l_quantity < 3"),
    ("filter_nor", {"$nor": [{"l_returnflag": "A"}, {"l_quantity": {"$lt": 30}}]}, "NOT (l_returnflag = 'A' OR l_quantity < 30)"),
    ("filter_not", {"$not": {"l_tax": {"$gt": 0.02}}}, "NOT (l_tax > 0.02)"),
    ("filter_not_field", {"l_tax": {"$not": {"$gte": 0.05}}}, "NOT (l_tax >= 0.05)"),
    ("filter_type", {"l_quantity": {"$type": "double"}, "l_linenumber": 3}, "l_linenumber = 3"),
    ("filter_families", {"$or": [{"l_returnflag": {"$gt": 5}}, {"l_quantity": "7"}, {"l_linenumber": 2}]}, "l_linenumber = 2"),
    ("filter_expr", {"$expr": {"$gt": ["$l_discount", "$l_tax"]}}, "l_discount > l_tax"),
    ("filter_empty_or", {"$or": [{"$or": []}, {"$and": [{}, {"l_linenumber": 5}]}]}, "l_linenumber = 5"),
):
    _lineitem_filter(_name, _spec, _where)


def nullable(s: SparkSession, d: str) -> DataFrame:
    """lineitem with a nullable field: the discount, null where it is 0."""
    return table(s, d, "lineitem").withColumn("x", F.nullif("l_discount", F.lit(0.0)))


_x = "(SELECT *, nullif(l_discount, 0) AS x FROM lineitem)"
for _name, _spec, _where in (
    ("null_eq", {"x": None}, "x IS NULL"),
    ("null_ne", {"x": {"$ne": None}}, "x IS NOT NULL"),
    ("null_ne_value", {"x": {"$ne": 0.05}}, "x IS NULL OR x <> 0.05"),
    ("null_nin", {"x": {"$nin": [0.05, 0.06]}}, "x IS NULL OR x NOT IN (0.05, 0.06)"),
    ("null_not_gt", {"$not": {"x": {"$gt": 0.05}}}, "coalesce(NOT (x > 0.05), TRUE)"),
    ("null_exists", {"x": {"$exists": True}}, "x IS NOT NULL"),
    ("null_not_exists", {"x": {"$exists": False}, "nowhere": {"$exists": False}}, "x IS NULL"),
    ("null_expr_eq", {"$expr": {"$eq": ["$x", "$nowhere"]}}, "x IS NULL"),
):
    query(_name, f"SELECT l_orderkey, l_linenumber FROM {_x} WHERE {_where}")(lambda s, d, spec=_spec: find(nullable(s, d), spec).select(*_keys))


@query("filter_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(small|hot) .*[gr]$')")
def _(s: SparkSession, d: str) -> DataFrame:
    return find(table(s, d, "part"), {"p_name": {"$regex": "^(small|hot) .*[gr]$"}}).select("p_partkey")


@query("filter_regex_contains", "SELECT p_partkey FROM part WHERE contains(p_type, 'E')")
def _(s: SparkSession, d: str) -> DataFrame:
    return find(table(s, d, "part"), {"p_type": {"$regex": "E"}}, regex_mode="contains").select("p_partkey")


@query("filter_text", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'part') AND contains(lower(p_name), '7') OR contains(lower(p_brand), '7') OR contains(lower(p_type), '7') OR contains(lower(p_name), '7')")
def _(s: SparkSession, d: str) -> DataFrame:
    return find(table(s, d, "part"), {"$text": {"$search": "7"}}).select("p_partkey")


@query("filter_nested", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 90")
def _(s: SparkSession, d: str) -> DataFrame:
    return find(table(s, d, "events").withColumn("props", F.from_json("props", "k long")), {"props.k": {"$gt": 90}}).select("event_id")


@query("filter_variant", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 10")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "events").withColumn("doc", F.parse_json("props"))
    return find(docs, {"doc.k": {"$lte": 10, "$exists": True, "$type": "long"}, "doc.z": {"$exists": False}}).select("event_id")


def line_arrays(s: SparkSession, d: str) -> DataFrame:
    """Orders with their line numbers and flags in arrays."""
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))).alias("items"))


_lines = "(SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS lines, max(l_quantity) FILTER (l_returnflag = 'R') AS q FROM lineitem GROUP BY 1)"
for _name, _spec, _where in (
    ("array_all", {"lines": {"$all": [1, 4]}}, "list_has_all(lines, [1, 4])"),
    ("array_size", {"lines": {"$size": 3}}, "len(lines) = 3"),
    ("array_elem_match_value", {"lines": {"$elemMatch": 6}}, "list_contains(lines, 6)"),
    ("array_elem_match_filter", {"items": {"$elemMatch": {"l_returnflag": "R", "l_quantity": {"$gt": 40}}}}, "q > 40"),
    ("array_place", {"lines.0": 1, "lines.2": {"$gt": 2}}, "lines[1] = 1 AND lines[3] > 2"),
    ("array_no_implicit_match", {"$or": [{"lines": 1}, {"lines": {"$size": 2}}]}, "len(lines) = 2"),
):
    query(_name, f"SELECT l_orderkey FROM {_lines} WHERE {_where}")(lambda s, d, spec=_spec: find(line_arrays(s, d), spec).select("l_orderkey"))


def points(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.array(F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")).alias("location"))


_points = "(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
for _name, _spec, _where in (
    ("geo_box", {"location": {"$geoWithin": {"$box": [[-0.1, -0.1], [0.1, 0.05]]}}}, "x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.05"),
    ("geo_near", {"location": {"$near": {"$geometry": {"type": "Point", "coordinates": [0.05, 0.0]}, "$maxDistance": 0.1}}}, "sqrt((x - 0.05) ** 2 + y ** 2) <= 0.1"),
    ("geo_polygon", {"location": {"$geoWithin": {"$polygon": [[-0.1, -0.1], [0.1, -0.1], [0.1, 0.1], [-0.1, 0.1]]}}}, "x > -0.1 AND x < 0.1 AND y > -0.1 AND y < 0.1"),
):
    query(_name, f"SELECT vec_id FROM {_points} WHERE {_where}")(lambda s, d, spec=_spec: find(points(s, d), spec).select("vec_id"))


@query("geo_distance", f"SELECT vec_id, round(2 * 6371008.8 * asin(least(1.0, sqrt(sin(radians(-y) / 2) ** 2 + cos(radians(y)) * sin(radians(-x) / 2) ** 2))), 3) AS m FROM {_points}")
def _(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return p.select("vec_id", F.round(meters(F.col("location")[0], F.col("location")[1], F.lit(0.0), F.lit(0.0)), 3).alias("m"))


# ---- find options and projections


@query("find_sort_skip_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def _(s: SparkSession, d: str) -> DataFrame:
    return find(table(s, d, "orders"), None, {"o_orderkey": 1, "o_totalprice": 1}, {"o_totalprice": -1, "o_orderkey": 1}, 10, 20)


@query("find_exclude", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000")
def _(s: SparkSession, d: str) -> DataFrame:
    return find(table(s, d, "customer"), {"c_acctbal": {"$gt": 9000}}, {"c_nationkey": 0, "c_mktsegment": 0})


@query("sort_nulls", f"SELECT l_orderkey, l_linenumber, x FROM {_x} ORDER BY x DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 50")
def _(s: SparkSession, d: str) -> DataFrame:
    return find(nullable(s, d), None, {"l_orderkey": 1, "l_linenumber": 1, "x": 1}, {"x": -1, "l_orderkey": 1, "l_linenumber": 1}, None, 50)


@query("project_computed", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, upper(l_returnflag) || '-' || l_linestatus AS tag FROM lineitem WHERE l_linenumber = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "lineitem", [{"$match": {"l_linenumber": 1}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "net": {"$round": [{"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, {"$literal": 4}]}, "tag": {"$concat": [{"$toUpper": "$l_returnflag"}, "-", "$l_linestatus"]}}}])


@query("project_exclude", "SELECT n_nationkey, n_name FROM nation")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "nation", [{"$project": {"n_regionkey": 0}}])


@query("add_fields", "SELECT p_partkey, p_size AS size, 'x' AS kind, p_size AS again FROM part")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "part", [{"$addFields": {"size": "$p_size", "kind": "x", "again": "$size"}}, {"$project": {"p_partkey": 1, "size": 1, "kind": 1, "again": 1}}])


@query("replace_root", "SELECT l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_linenumber > 5")
def _(s: SparkSession, d: str) -> DataFrame:
    return run_pipeline(line_arrays(s, d), [{"$unwind": "$items"}, {"$match": {"items.l_linenumber": {"$gt": 5}}}, {"$replaceRoot": {"newRoot": "$items"}}])


@query("count_stage", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}])


@query("skip_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 100")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$sort": {"o_orderkey": 1}}, {"$skip": 100}, {"$limit": 7}, {"$project": {"o_orderkey": 1}}])


@query("unwind", "SELECT l_orderkey, l_linenumber AS lines FROM lineitem")
def _(s: SparkSession, d: str) -> DataFrame:
    return run_pipeline(line_arrays(s, d), [{"$unwind": "$lines"}, {"$project": {"l_orderkey": 1, "lines": 1}}])


@query("unwind_index", "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS BIGINT) AS i, l_linenumber AS lines FROM lineitem")
def _(s: SparkSession, d: str) -> DataFrame:
    return run_pipeline(line_arrays(s, d), [{"$unwind": {"path": "$lines", "includeArrayIndex": "i"}}, {"$project": {"l_orderkey": 1, "lines": 1, "i": 1}}])


@query("unwind_preserve", "SELECT c_custkey, o_orderkey AS keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o", "pipeline": [{"$project": {"o_custkey": 1, "o_orderkey": 1}}]}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "keys": "$o.o_orderkey"}}])


# ---- groups

BENCH = [{"$match": {"l_quantity": {"$gt": 20}}}, {"$group": {"_id": "$l_returnflag", "total": {"$sum": "$l_extendedprice"}}}, {"$sort": {"total": -1}}]


@query("match_group_sort", 'SELECT l_returnflag AS "_id", round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 20 GROUP BY 1')
def match_group_sort(s: SparkSession, d: str) -> DataFrame:
    return rounded(pipeline(s, d, "lineitem", BENCH), total=2)


@query("group_all_accumulators", 'SELECT l_returnflag AS "_id", CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS n, CAST(count(*) * 2 AS BIGINT) AS twice, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_tax), 6) AS sdp FROM lineitem GROUP BY 1')
def _(s: SparkSession, d: str) -> DataFrame:
    df = pipeline(s, d, "lineitem", [{"$group": {"_id": "$l_returnflag", "s": {"$sum": "$l_linenumber"}, "n": {"$count": {}}, "twice": {"$sum": {"$toLong": 2}}, "lo": {"$min": "$l_quantity"}, "hi": {"$max": "$l_quantity"}, "mean": {"$avg": "$l_quantity"}, "sd": {"$stdDevSamp": "$l_quantity"}, "sdp": {"$stdDevPop": "$l_tax"}}}])
    return rounded(df, mean=6, sd=6, sdp=6)


@query("group_avg_of_missing", f'SELECT l_returnflag AS "_id", round(sum(coalesce(x, 0)) / count(*), 6) AS mean, round(avg(x), 6) AS strict FROM {_x} GROUP BY 1')
def _(s: SparkSession, d: str) -> DataFrame:
    loose = run_pipeline(nullable(s, d), [{"$group": {"_id": "$l_returnflag", "mean": {"$avg": "$x"}}}])
    strict = run_pipeline(nullable(s, d), [{"$group": {"_id": "$l_returnflag", "strict": {"$avg": "$x"}}}], strict_avg=True)
    return rounded(loose.join(strict, "_id"), mean=6, strict=6)


@query("group_global", 'SELECT CAST(NULL AS VARCHAR) AS "_id", count(*) AS n FROM orders HAVING count(*) > 0')
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$group": {"_id": None, "n": {"$sum": 1}}}]).withColumn("n", F.col("n").cast("long"))


@query("group_empty", 'SELECT CAST(NULL AS VARCHAR) AS "_id", CAST(0 AS BIGINT) AS n WHERE FALSE')
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$match": {"o_orderkey": {"$lt": 0}}}, {"$group": {"_id": None, "n": {"$count": {}}}}])


@query("group_compound", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "lineitem", [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$count": {}}}}, {"$project": {"_id": 0, "flag": "$_id.flag", "status": "$_id.status", "n": 1}}])


@query("group_first_last", 'SELECT o_custkey AS "_id", arg_min(o_orderkey, o_orderkey) AS a, arg_max(o_orderkey, o_orderkey) AS b, arg_min(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY 1')
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "a": {"$first": "$o_orderkey"}, "b": {"$last": "$o_orderkey"}, "st": {"$first": "$o_orderstatus"}}}])


@query("group_push", "SELECT o_custkey AS \"_id\", array_to_string(list(o_orderkey ORDER BY o_orderkey DESC), ',') AS keys FROM orders GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$sort": {"o_orderkey": -1}}, {"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}}}]).withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ","))


@query("group_add_to_set", "SELECT o_custkey AS \"_id\", array_to_string(list(DISTINCT o_orderstatus ORDER BY o_orderstatus), ',') AS st FROM orders GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$group": {"_id": "$o_custkey", "st": {"$addToSet": "$o_orderstatus"}}}]).withColumn("st", F.array_join("st", ","))


@query("group_top_n", 'SELECT o_custkey AS "_id", array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:2], \',\') AS best, max(o_totalprice) AS hi FROM orders GROUP BY 1')
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$group": {"_id": "$o_custkey", "best": {"$topN": {"n": 2, "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "hi": {"$maxN": {"n": 1, "input": "$o_totalprice"}}}}]).withColumn("best", F.array_join(F.col("best").cast("array<string>"), ",")).withColumn("hi", F.col("hi")[0])


@query("group_distinct", "SELECT DISTINCT o_orderpriority AS \"_id\" FROM orders")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$group": {"_id": "$o_orderpriority"}}])


@query("bucket", "SELECT CASE WHEN p_size >= 0 AND p_size < 10 THEN '0' WHEN p_size >= 10 AND p_size < 30 THEN '10' ELSE 'Other' END AS \"_id\", count(*) AS count FROM part GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 30]}}])


@query("bucket_output", 'SELECT CASE WHEN o_totalprice >= 0 AND o_totalprice < 100000 THEN 0 WHEN o_totalprice >= 100000 AND o_totalprice < 200000 THEN 100000 ELSE -1 END AS "_id", count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY 1')
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$bucket": {"groupBy": "$o_totalprice", "boundaries": [0, 100000, 200000], "default": -1, "output": {"n": {"$count": {}}, "hi": {"$max": "$o_totalprice"}}}}])


@query("bucket_auto", """WITH p AS (SELECT quantile_disc(p_size, [0.25, 0.5, 0.75]) AS q, min(p_size) AS lo FROM part)
SELECT CASE WHEN p_size >= q[3] THEN q[3] WHEN p_size >= q[2] THEN q[2] WHEN p_size >= q[1] THEN q[1] ELSE lo END AS "_id", count(*) AS count FROM part, p GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "part", [{"$bucketAuto": {"groupBy": "$p_size", "buckets": 4}}])


@query("facet", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS f, (SELECT string_agg(o_orderpriority || ':' || n, ',' ORDER BY o_orderpriority) FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)) AS p")
def _(s: SparkSession, d: str) -> DataFrame:
    df = pipeline(s, d, "orders", [{"$facet": {"f": [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "p": [{"$group": {"_id": "$o_orderpriority", "n": {"$count": {}}}}, {"$sort": {"_id": 1}}]}}])
    return df.select(F.col("f")[0]["n"].alias("f"), F.array_join(F.transform("p", lambda x: F.concat(x["_id"], F.lit(":"), x["n"].cast("string"))), ",").alias("p"))


@query("sort_by_count", 'SELECT c_mktsegment AS "_id", count(*) AS count FROM customer GROUP BY 1')
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "customer", [{"$sortByCount": "$c_mktsegment"}])


# ---- joins


@query("lookup", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "nation", [{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$project": {"n_nationkey": 1, "n_name": 1, "r_name": "$r.0.r_name"}}])


@query("lookup_pipeline", "SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS hi FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000 GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    df = pipeline(s, d, "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "big", "pipeline": [{"$match": {"o_totalprice": {"$gt": 150000}}}, {"$project": {"o_custkey": 1, "o_totalprice": 1}}]}}])
    return df.select("c_custkey", F.size("big").cast("long").alias("n"), F.array_max(F.transform("big", lambda o: o["o_totalprice"])).alias("hi"))


@query("graph_lookup", "SELECT n_nationkey, CAST(1 AS BIGINT) AS k FROM nation")
def _(s: SparkSession, d: str) -> DataFrame:
    df = pipeline(s, d, "nation", [{"$graphLookup": {"from": "region", "startWith": "$n_regionkey", "connectFromField": "r_regionkey", "connectToField": "r_regionkey", "as": "g", "maxDepth": 2}}])
    return df.select("n_nationkey", F.size("g").cast("long").alias("k"))


@query("union_with", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "nation", [{"$project": {"name": "$n_name"}}, {"$unionWith": {"coll": "region", "pipeline": [{"$project": {"name": "$r_name"}}]}}])


@query("relation_violations", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def _(s: SparkSession, d: str) -> DataFrame:
    return relations.violations(table(s, d, "orders"), find(table(s, d, "customer"), {"c_acctbal": {"$gt": 0}}), "o_custkey", "c_custkey").select("o_orderkey")


@query("relation_soft", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS valid FROM customer")
def _(s: SparkSession, d: str) -> DataFrame:
    return relations.validate(table(s, d, "customer"), table(s, d, "orders"), "c_custkey", "o_custkey", "soft").select("c_custkey", "valid")


@query("relation_populate_one", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(s: SparkSession, d: str) -> DataFrame:
    return relations.populate(table(s, d, "customer"), table(s, d, "nation"), "c_nationkey", "n_nationkey", "nation", one=True).select("c_custkey", F.col("nation.n_name").alias("n_name"))


@query("cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(s: SparkSession, d: str) -> DataFrame:
    gone = find(table(s, d, "customer"), {"c_acctbal": {"$lt": 0}})
    return relations.on_delete(table(s, d, "orders"), gone, "o_custkey", "c_custkey").select("o_orderkey")


@query("set_null_delete", "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(s: SparkSession, d: str) -> DataFrame:
    gone = find(table(s, d, "customer"), {"c_acctbal": {"$lt": 0}})
    return relations.on_delete(table(s, d, "orders"), gone, "o_custkey", "c_custkey", "set_null").select("o_orderkey", "o_custkey")


@query("cascade_update", "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(s: SparkSession, d: str) -> DataFrame:
    moved = find(table(s, d, "customer"), {"c_acctbal": {"$lt": 0}}).select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return relations.on_update(table(s, d, "orders"), moved, "o_custkey").select("o_orderkey", "o_custkey")


# ---- windows


@query("window_rank", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)")
def _(s: SparkSession, d: str) -> DataFrame:
    df = pipeline(s, d, "customer", [{"$setWindowFields": {"partitionBy": "$c_nationkey", "sortBy": {"c_mktsegment": 1}, "output": {"r": {"$rank": {}}, "dr": {"$denseRank": {}}}}}, {"$setWindowFields": {"partitionBy": "$c_nationkey", "sortBy": {"c_acctbal": -1, "c_custkey": 1}, "output": {"rn": {"$documentNumber": {}}}}}])
    return df.select("c_custkey", *[F.col(c).cast("long").alias(c) for c in ("r", "dr", "rn")])


@query("window_shift_running", "SELECT o_orderkey, lag(o_totalprice) OVER w AS was, lead(o_orderkey, 2, -1) OVER w AS nxt, round(sum(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total, max(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(s: SparkSession, d: str) -> DataFrame:
    df = pipeline(s, d, "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderkey": 1}, "output": {"was": {"$shift": {"output": "$o_totalprice", "by": -1}}, "nxt": {"$shift": {"output": "$o_orderkey", "by": 2, "default": -1}}, "total": {"$sum": "$o_totalprice", "window": {"documents": ["unbounded", "current"]}}, "hi": {"$max": "$o_totalprice", "window": {"documents": [-2, 1]}}}}}])
    return rounded(df, total=2).select("o_orderkey", "was", "nxt", "total", "hi")


@query("window_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "events", [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": {"n": {"$count": {}, "window": {"range": [-1, "current"], "unit": "hour"}}}}}]).select("event_id", "n")


@query("densify", """WITH g AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM g GROUP BY 1), s AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM b)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM s LEFT JOIN g USING (user_id, day)""")
def _(s: SparkSession, d: str) -> DataFrame:
    days = table(s, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    df = run_pipeline(days, [{"$densify": {"field": "day", "partitionByFields": ["user_id"], "range": {"step": 1, "unit": "day", "bounds": "partition"}}}, {"$fill": {"output": {"n": {"value": 0}}}}])
    return df.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("n").cast("long").alias("n"))


@query("fill_locf", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return run_pipeline(e, [{"$fill": {"partitionByFields": ["user_id"], "sortBy": {"ts": 1, "event_id": 1}, "output": {"v": {"method": "locf"}}}}]).select("event_id", "v")


@query("fill_linear", """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER w AS x0, last_value(v IGNORE NULLS) OVER w AS y0, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS x1, first_value(v IGNORE NULLS) OVER b AS y1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, y0 + (y1 - y0) * (event_id - x0) / nullif(x1 - x0, 0)), 6) AS v FROM k""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return rounded(run_pipeline(e, [{"$fill": {"partitionByFields": ["user_id"], "sortBy": {"event_id": 1}, "output": {"v": {"method": "linear"}}}}]).select("event_id", "v"), v=6)


_sets = "(SELECT o_orderpriority AS key, o_custkey AS member, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY 1, 2)"


def sorted_sets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))


@query("z_rank", f"SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM {_sets}")
def _(s: SparkSession, d: str) -> DataFrame:
    return stores.ranked(sorted_sets(s, d)).withColumn("rank", F.col("rank").cast("long"))


@query("z_range", f"SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM {_sets}) WHERE r >= 2 AND r <= n - 5")
def _(s: SparkSession, d: str) -> DataFrame:
    return stores.z_range(sorted_sets(s, d), 2, -5, reverse=True).select("key", "member")


@query("z_range_by_score", f"SELECT key, member FROM {_sets} WHERE score BETWEEN 100000 AND 200000")
def _(s: SparkSession, d: str) -> DataFrame:
    return stores.z_range_by_score(sorted_sets(s, d), 100000, 200000).select("key", "member")


@query("leaderboard", f"SELECT key, member, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member) AS rank FROM {_sets}) WHERE rank <= 5")
def _(s: SparkSession, d: str) -> DataFrame:
    return stores.leaderboard(sorted_sets(s, d), 5).withColumn("rank", F.col("rank").cast("long"))


@query("global_leaderboard", f"SELECT member, round(sum(score), 2) AS score, count(*) AS groups FROM {_sets} WHERE starts_with(key, '1') OR starts_with(key, '1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(stores.global_leaderboard(sorted_sets(s, d), "1", 10), score=2)


# ---- set operations and further SQL-like operators


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(s: SparkSession, d: str) -> DataFrame:
    return stores.union(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = (find(table(s, d, "orders"), {"o_orderstatus": x}).select(F.col("o_custkey").alias("k")) for x in "FO")
    return stores.intersect(a, b)


@query("set_except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return stores.except_(o.select(F.col("o_custkey").alias("k")), find(o, {"o_orderstatus": "O"}).select(F.col("o_custkey").alias("k")), all_=True)


@query("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = pipeline(s, d, "lineitem", [{"$group": {"_id": {"l_returnflag": "$l_returnflag", "l_linestatus": "$l_linestatus"}, "$grouping": "rollup", "n": {"$count": {}}}}])
    return rows.select("_id.*", "n")


@query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = pipeline(s, d, "orders", [{"$group": {"_id": {"o_orderstatus": "$o_orderstatus", "o_orderpriority": "$o_orderpriority"}, "$grouping": "cube", "n": {"$count": {}}}}])
    return rows.select("_id.*", "n")


@query("aggregate_catalog", "SELECT o_orderstatus AS \"_id\", bool_or(o_totalprice > 300000) AS any_big, bit_or(o_orderkey) AS bits, median(o_totalprice) AS mid, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$group": {"_id": "$o_orderstatus", "any_big": {"$boolOr": {"$gt": ["$o_totalprice", 300000]}}, "bits": {"$bitOr": "$o_orderkey"}, "mid": {"$median": "$o_totalprice"}, "customers": {"$countDistinct": "$o_custkey"}}}])


def sql(spark: SparkSession, d: str, text: str, params: Any = None) -> DataFrame:
    return ansi.select(spark, text, tables_in(spark, d), TABLES, params)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")


for _name, _text, _sql in (
    ("sql_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 120000 AND (o_orderstatus = 'F' OR o_orderstatus = 'P')", None),
    ("sql_like_in_between", "SELECT p_partkey FROM part WHERE p_name LIKE '%e_ b%' AND p_size NOT IN (1, 2) AND p_retailprice BETWEEN 900 AND 1500 AND p_brand IS NOT NULL", None),
    ("sql_not", "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)", None),
    ("sql_order_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10 OFFSET 5", None),
    ("sql_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", None),
    ("sql_left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey", None),
    ("sql_group", "SELECT o_orderstatus, COUNT(*) AS n, MAX(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus", None),
    ("sql_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 15", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    ("sql_distinct", "SELECT DISTINCT c_mktsegment FROM customer", None),
    ("sql_param", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_name <> 'X'", None),
    ("sql_right_join", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey", None),
    ("sql_full_join", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey", None),
    ("sql_cross_join", "SELECT n_name, r_name FROM nation CROSS JOIN region", None),
    ("sql_cte_union", "WITH a AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT k, max(p) AS p FROM a GROUP BY k) SELECT k, p FROM b WHERE p > 300000 UNION SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -900", None),
    ("sql_subquery", "SELECT q.o_orderstatus, q.n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) q WHERE q.n > (SELECT avg(x) FROM (SELECT count(*) AS x FROM orders GROUP BY o_orderpriority))", None),
    ("sql_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", None),
    ("sql_case_functions", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS p, coalesce(nullif(o_orderstatus, 'F'), 'done') AS st, CAST(o_orderkey % 7 AS INT) AS m FROM orders", None),
    ("sql_window", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders", None),
    ("sql_join_conditions", "SELECT count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate CROSS JOIN (VALUES (1)) AS one(x) WHERE l.l_quantity > 30", None),
    ("sql_three_valued", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE CASE WHEN NOT (o_totalprice > 100000) THEN 1 ELSE 0 END = 1 AND o_totalprice NOT IN (1, 2)", None),
    ("sql_nulls_first", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey ORDER BY o_orderkey NULLS FIRST, c_custkey DESC LIMIT 20", None),
    ("sql_intersect_except", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0", None),
    ("sql_unnest", "SELECT vec_id, unnest(embedding) AS x FROM embeddings WHERE vec_id < 4", None),
    ("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
):
    query(_name, _sql or _text)(lambda s, d, text=_text: sql(s, d, text))
QUERIES["sql_param"] = lambda s, d: sql(s, d, "SELECT n_name FROM nation WHERE n_regionkey = ? AND n_name <> ?", [2, "X"])


# ---- updates


def _update(name: str, spec: dict, where: dict, columns: str, text: str, base: str = "orders") -> None:
    query(name, text)(lambda s, d: apply_update(table(s, d, base), spec, where).selectExpr(*[c.strip() for c in columns.split(";")]))


_update("update_set", {"$set": {"o_orderstatus": "X", "note": "seen"}}, {"o_totalprice": {"$gt": 200000}}, "o_orderkey;o_orderstatus;note", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'seen' END AS note FROM orders")
_update("update_inc", {"$inc": {"o_custkey": 5, "seen": 1}}, {"o_orderstatus": "F"}, "o_orderkey;o_custkey;cast(seen as bigint) as seen", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 5 ELSE o_custkey END AS o_custkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 END AS BIGINT) AS seen FROM orders")
_update("update_mul", {"$mul": {"o_totalprice": 2}}, {"o_orderstatus": "O"}, "o_orderkey;o_totalprice", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
_update("update_min_max", {"$min": {"o_totalprice": 100000.0}, "$max": {"o_custkey": 50}}, {}, "o_orderkey;o_totalprice;o_custkey", "SELECT o_orderkey, least(o_totalprice, 100000.0) AS o_totalprice, greatest(o_custkey, 50) AS o_custkey FROM orders")
_update("update_unset_rename", {"$unset": {"o_orderpriority": ""}, "$rename": {"o_orderstatus": "status"}}, {"o_orderstatus": "F"}, "o_orderkey;o_orderpriority;o_orderstatus;status", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'F' END AS status FROM orders")


def _array_update(name: str, spec: dict, text: str) -> None:
    query(name, f"SELECT l_orderkey, array_to_string({text}, ',') AS lines FROM {_lines}")(lambda s, d: apply_update(line_arrays(s, d), spec).select("l_orderkey", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines")))


_array_update("update_push", {"$push": {"lines": {"$each": [8, 9]}}}, "list_concat(lines, [8, 9])")
_array_update("update_pull", {"$pull": {"lines": 1}}, "list_filter(lines, lambda x: x <> 1)")
_array_update("update_pull_all", {"$pullAll": {"lines": [1, 3]}}, "list_filter(lines, lambda x: x NOT IN (1, 3))")
_array_update("update_add_to_set", {"$addToSet": {"lines": {"$each": [3, 9]}}}, "CASE WHEN list_contains(lines, 3) THEN list_append(lines, 9) ELSE list_concat(lines, [3, 9]) END")
_array_update("update_pop", {"$pop": {"lines": -1}}, "lines[2:]")


@query("update_nested", "SELECT n_nationkey, n_name || '/' || 'EU' AS v FROM nation WHERE n_regionkey = 3")
def _(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").where("n_regionkey = 3").withColumn("a", F.struct("n_name"))
    return apply_update(n, {"$set": {"a.zone.code": "EU"}}).select("n_nationkey", F.concat("a.n_name", F.lit("/"), "a.zone.code").alias("v"))


@query("builder_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 90000 AND o_orderstatus IN ('F', 'O') ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10")
def _(s: SparkSession, d: str) -> DataFrame:
    q = Query().where_between("o_totalprice", 1000, 90000).where_in("o_orderstatus", ["F", "O"]).select("o_orderkey", "o_totalprice").sort_by("o_totalprice", "desc").sort_by("o_orderkey").page(2, 10)
    return find(table(s, d, "orders"), q.to_mql(), **q.options)


@query("builder_filter", "SELECT p_partkey FROM part WHERE NOT (p_size > 10 OR p_brand = 'Brand#11')")
def _(s: SparkSession, d: str) -> DataFrame:
    return find(table(s, d, "part"), FilterBuilder().gt("p_size", 10).nor({"p_brand": "Brand#11"}).build()).select("p_partkey")


@query("builder_aggregate", 'SELECT l_linestatus AS "_id", max(l_quantity) AS hi FROM lineitem WHERE l_linenumber = 1 GROUP BY 1')
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "lineitem", Aggregate().match({"l_linenumber": 1}).group({"_id": "$l_linestatus", "hi": {"$max": "$l_quantity"}}).sort({"_id": 1}).to_pipeline())


@query("builder_update", "SELECT c_custkey, c_acctbal + 10 AS c_acctbal FROM customer")
def _(s: SparkSession, d: str) -> DataFrame:
    return apply_update(table(s, d, "customer"), UpdateBuilder().inc("c_acctbal", 10.0).unset("c_name").build()).select("c_custkey", "c_acctbal")


# ---- scalar functions


@query("scalar_catalog", """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofmonth(o_orderdate) AS dd, upper(substr(o_orderpriority, 3, 4)) AS u, length(o_orderpriority) AS n, replace(o_orderpriority, '-', '_') AS r,
abs(o_custkey - 75) AS a, o_custkey % 7 AS md, CAST(floor(o_totalprice) AS BIGINT) AS fl, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS c, CAST(o_orderkey AS VARCHAR) AS st, split_part(o_orderpriority, '-', 1) AS sp FROM orders""")
def _(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "orders")
    e = {
        "y": {"$year": "$o_orderdate"}, "m": {"$month": "$o_orderdate"}, "dd": {"$dayOfMonth": "$o_orderdate"}, "u": {"$toUpper": {"$substrCP": ["$o_orderpriority", 2, 4]}}, "n": {"$strLenCP": "$o_orderpriority"}, "r": {"$replaceAll": ["$o_orderpriority", "-", "_"]},
        "a": {"$abs": {"$subtract": ["$o_custkey", 75]}}, "md": {"$mod": ["$o_custkey", 7]}, "fl": {"$floor": "$o_totalprice"}, "c": {"$cond": [{"$gt": ["$o_totalprice", 100000]}, "big", "small"]}, "st": {"$toString": "$o_orderkey"}, "sp": {"$split": ["$o_orderpriority", "-", 1]},
    }
    out = df.select("o_orderkey", *[expression(of(df), x).alias(k) for k, x in e.items()])
    return out.withColumns({c: F.col(c).cast("long") for c in ("y", "m", "dd", "n", "fl")})


# ---- search


def _stem_sql(w: str) -> str:
    out = f"CASE WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND strlen({w}) > 3 THEN left({w}, -1) ELSE {w} END"
    for suffix, least in reversed(search.SUFFIXES):
        out = f"CASE WHEN {w} LIKE '%{suffix}' AND strlen({w}) > {least} THEN left({w}, -{len(suffix)}) ELSE {out} END"
    return out


_terms = f"""t AS (SELECT doc_id, {_stem_sql('w')} AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents) WHERE strlen(w) >= 2),
q AS (SELECT {_stem_sql('w')} AS term, count(*) AS times FROM (SELECT unnest(['theres', 'shing', 'the']) AS w) GROUP BY 1),
tf AS (SELECT doc_id, term, times, count(*) AS tf FROM t JOIN q USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""


@query("search_tf_idf", f"WITH {_terms} SELECT doc_id, round(sum(times * (1 + ln(tf)) * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1)), 6) AS score FROM tf JOIN df USING (term) GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(search.tf_idf(table(s, d, "documents"), "theres shing the"), score=6)


@query("search_bm25", f"WITH {_terms}, l AS (SELECT doc_id, count(*) AS size FROM t GROUP BY 1), m AS (SELECT count(*) AS n, sum(coalesce(size, 0)) / count(*) AS mean FROM documents LEFT JOIN l USING (doc_id)) SELECT doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN l USING (doc_id), m GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(search.bm25(table(s, d, "documents"), "theres shing the"), score=6)


@query("search_boolean", "SELECT doc_id FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2) AS w FROM documents) WHERE list_contains(w, 'the') AND NOT list_contains(w, 'shing')")
def _(s: SparkSession, d: str) -> DataFrame:
    return search.boolean(table(s, d, "documents"), "+the -shing").select("doc_id")


@query("search_phrase", "SELECT doc_id FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2) AS w FROM documents) WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def _(s: SparkSession, d: str) -> DataFrame:
    return search.phrase(table(s, d, "documents"), "of the").select("doc_id")


@query("autocomplete", "SELECT c_custkey, c_name FROM customer WHERE starts_with(lower(c_name), 'customer#00000001') ORDER BY c_custkey LIMIT 8")
def _(s: SparkSession, d: str) -> DataFrame:
    return search.autocomplete(table(s, d, "customer"), "c_name", "CUSTOMER#00000001", 8, "c_custkey").select("c_custkey", "c_name")


@query("search_rrf", """WITH a AS (SELECT o_orderkey AS doc_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), b AS (SELECT o_orderkey AS doc_id, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS r FROM orders)
SELECT doc_id, round(1 / (60 + a.r) + 1 / (60 + b.r), 12) AS score FROM a JOIN b USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 20""")
def _(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice", "o_custkey")
    a, b = (o.select("doc_id", F.col(c).alias("score")) for c in ("o_totalprice", "o_custkey"))
    return search.top(rounded(search.rrf([a, b]), score=12), 20)


@query("vector_search", """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) DESC, vec_id LIMIT 10""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return rounded(vectors.vector_search(e, e.where("vec_id = 0").first()["embedding"], 10).select("vec_id", "score"), score=6)


@query("vector_filtered_l2", """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 3)
SELECT vec_id, round(-list_distance(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE label = 1 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), vec_id LIMIT 10""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return rounded(vectors.vector_search(e, e.where("vec_id = 3").first()["embedding"], 10, metric="l2", where={"label": 1}).select("vec_id", "score"), score=6)


# ---- time series, versions, streams


@query("time_buckets", "SELECT event_type AS meta, epoch_ms(ts) - epoch_ms(ts) % 3600000 AS bucket, count(*) AS n, max(value) AS hi FROM events GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    b = timeseries.bucket_documents(table(s, d, "events"), "ts", "event_type", "hours", ["value"])
    return b.select("meta", "bucket", F.col("count").alias("n"), F.array_max(F.transform("measurements", lambda m: m["value"])).alias("hi"))


@query("sessions", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events)
SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g""")
def _(s: SparkSession, d: str) -> DataFrame:
    return timeseries.sessions(table(s, d, "events"), "ts", "user_id", 3600).select("event_id", "session")


@query("debounce", "SELECT event_id FROM (SELECT event_id, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS later FROM events) WHERE later IS NULL OR later >= 600000000")
def _(s: SparkSession, d: str) -> DataFrame:
    return timeseries.debounce(table(s, d, "events"), "ts", "user_id", 600, "event_id").select("event_id")


@query("deduplicate", "SELECT arg_min(event_id, event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY user_id, event_type")
def _(s: SparkSession, d: str) -> DataFrame:
    return timeseries.deduplicate(table(s, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id")


@query("rate_limit", "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch_us(ts) / 1000000 / 86400) AS BIGINT) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    return timeseries.fixed_rate(table(s, d, "events"), "ts", "user_id", 86_400, 2, "event_id").select("event_id", "allowed")


@query("version_as_of", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events) WHERE v <= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC) = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return versions.as_of(versions.number(table(s, d, "events"), "user_id", ["ts", "event_id"]), "user_id", 3).select("user_id", "event_type", "value")


@query("version_changes", """WITH h AS (SELECT user_id, event_type, row_number() OVER w AS version, lag(event_type) OVER w AS old FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, version, old, event_type AS new FROM h WHERE version > 1 AND old <> event_type""")
def _(s: SparkSession, d: str) -> DataFrame:
    h = versions.number(table(s, d, "events"), "user_id", ["ts", "event_id"])
    return versions.changes(h, "user_id", ["event_type"]).select("user_id", F.col("version").cast("long").alias("version"), "old", "new")


@query("version_diff", """WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations), a AS (SELECT * FROM h WHERE v = 1), b AS (SELECT * FROM h WHERE v = 2)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, concat_ws(',', CASE WHEN a.role IS NOT NULL AND b.role IS NOT NULL AND a.role <> b.role THEN 'role' END, CASE WHEN a.text IS NOT NULL AND b.text IS NOT NULL AND a.text <> b.text THEN 'text' END) AS modified,
concat_ws(',', CASE WHEN b.role IS NULL AND a.role IS NOT NULL THEN 'role' END, CASE WHEN b.text IS NULL AND a.text IS NOT NULL THEN 'text' END) AS removed FROM a FULL JOIN b ON a.conv_id = b.conv_id""")
def _(s: SparkSession, d: str) -> DataFrame:
    h = versions.number(table(s, d, "conversations"), "conv_id", ["turn"])
    out = versions.diff(h.where("version = 1"), h.where("version = 2"), "conv_id", ["role", "text"])
    return out.select("conv_id", F.array_join("modified", ",").alias("modified"), F.array_join("removed", ",").alias("removed"))


@query("queue_pop", "SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= TIMESTAMP '1997-01-01' ORDER BY o_orderpriority, o_orderdate, o_orderdate, o_orderkey LIMIT 5")
def _(s: SparkSession, d: str) -> DataFrame:
    import datetime

    jobs = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus").isin("O", "P"), "pending").otherwise("done").alias("state"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("run_at"), F.col("o_orderdate").alias("created_at"))
    return stores.pop_candidates(jobs, datetime.datetime(1997, 1, 1)).select("id", "priority")


@query("kv_glob", "SELECT c_name AS key FROM customer WHERE regexp_matches(c_name, '^C.*1.[0-4]$')")
def _(s: SparkSession, d: str) -> DataFrame:
    return stores.keys(table(s, d, "customer").select(F.col("c_name").alias("key")), "C*1?[0-4]")


@query("change_state", "SELECT user_id AS key, arg_max(event_type, event_id) AS document FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def _(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), F.lit("u").alias("ns"), F.col("user_id").alias("key"), F.col("event_type").alias("document"))
    return changes.state_of(log).select("key", "document")


@query("reactive_diff", "SELECT o_custkey, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, nullif(f, 0) AS a, nullif(o, 0) AS b FROM orders GROUP BY 1) WHERE a IS DISTINCT FROM b")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = (find(table(s, d, "orders"), {"o_orderstatus": x}).groupBy("o_custkey").agg(F.count("*").alias("n")) for x in "FO")
    return changes.diff(a, b, "o_custkey")


@query("window_tumbling", "SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    w = changes.tumbling(table(s, d, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")])
    return w.select(millis("window.start").alias("start"), "event_type", "n")


@query("window_session", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM k GROUP BY user_id, s""")
def _(s: SparkSession, d: str) -> DataFrame:
    w = changes.session(table(s, d, "events"), "ts", "1 hour", ["user_id"], [F.count("*").alias("n")])
    return w.select("user_id", micros("session_window.start").alias("start"), "n")


@query("infer_schema", "SELECT 'n_nationkey' AS field, count(n_nationkey) AS present, count(*) FILTER (n_nationkey IS NULL) AS nulls FROM nation UNION ALL SELECT 'n_name', count(n_name), count(*) FILTER (n_name IS NULL) FROM nation UNION ALL SELECT 'n_regionkey', count(n_regionkey), count(*) FILTER (n_regionkey IS NULL) FROM nation")
def _(s: SparkSession, d: str) -> DataFrame:
    return stores.infer_schema(table(s, d, "nation")).select("field", "present", "nulls")


_kv = "(SELECT event_id AS seq, user_id AS key, CASE event_type WHEN 'purchase' THEN 'set' WHEN 'signup' THEN 'setnx' WHEN 'error' THEN 'del' ELSE 'incr' END AS op, CAST(event_id % 10 AS BIGINT) AS value FROM events)"


@query("kv_replay", f"""WITH a AS (SELECT *, lag(op) OVER w AS was FROM {_kv} WINDOW w AS (PARTITION BY key ORDER BY seq)),
b AS (SELECT *, op IN ('set', 'del') OR (op = 'setnx' AND (was IS NULL OR was = 'del')) AS reset FROM a), c AS (SELECT * FROM b WHERE reset OR op = 'incr'),
r AS (SELECT key, max(seq) FILTER (reset) AS top FROM c GROUP BY 1), d AS (SELECT c.* FROM c JOIN r USING (key) WHERE top IS NULL OR seq >= top)
SELECT key, CAST(sum(CASE WHEN op = 'del' THEN 0 ELSE value END) AS BIGINT) AS value FROM d GROUP BY 1 HAVING count(*) FILTER (op <> 'del') > 0""")
def _(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "signup", "setnx").when(F.col("event_type") == "error", "del").otherwise("incr")
    log = table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), kind.alias("op"), (F.col("event_id") % 10).alias("value"))
    return kv.replay(log, ["key"])


@query("token_bucket", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT user_id, event_id, sec, k, CAST(2 AS DOUBLE) AS had FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.sec, e.k, least(CAST(2 AS DOUBLE), (CASE WHEN b.had >= 1 THEN b.had - 1 ELSE b.had END) + (e.sec - b.sec) * (CAST(1 AS DOUBLE) / 86400)) FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
SELECT user_id, event_id, had >= 1 AS allowed FROM b""")
def _(s: SparkSession, d: str) -> DataFrame:
    return kv.token_bucket(table(s, d, "events"), "user_id", "ts", "event_id", 1 / 86_400, 2)


@query("pub_sub", "SELECT event_id, CAST((event_type = 'click') AS INT) + CAST(contains(event_type, 'i') AS INT) + 1 AS delivered FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    return kv.published(table(s, d, "events").withColumn("channel", F.col("event_type")), ["click", "*i*", "*"]).select("event_id", "delivered")


@query("queue_metrics", "SELECT count(*) FILTER (event_type = 'purchase') AS processed, count(*) FILTER (event_type = 'error') AS failed, CAST(round(avg(value) FILTER (event_type = 'purchase')) AS BIGINT) AS latency FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", "processed").when(F.col("event_type") == "error", "failed")
    return stores.queue_metrics(table(s, d, "events").select(state.alias("state"), F.col("value").alias("latency_ms"))).select("processed", "failed", "latency")


@query("audit_log", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(s: SparkSession, d: str) -> DataFrame:
    return stores.audit(table(s, d, "events").withColumn("op", F.col("event_type")).withColumn("seq", F.col("event_id")), "error", 20).select("event_id")


@query("field_access", "SELECT c_custkey, c_name FROM customer")
def _(s: SparkSession, d: str) -> DataFrame:
    return stores.visible(table(s, d, "customer"), {"c_custkey", "c_name", "c_secret"})


@query("kv_lists", "SELECT user_id AS key, list(event_id ORDER BY CASE WHEN event_type IN ('click', 'view') THEN -event_id ELSE event_id END)[1:4] AS values FROM events WHERE event_type <> 'error' AND event_id > coalesce((SELECT max(event_id) FROM events x WHERE x.user_id = events.user_id AND x.event_type = 'error'), -1) GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "del").when(F.col("event_type").isin("click", "view"), "lpush").otherwise("rpush")
    log = table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), F.col("event_id").alias("value"))
    return kv.list_range(kv.lists(log), 0, 3)


@query("search_near", "SELECT doc_id FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2) AS w FROM documents) WHERE len(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('the', 'on') AND list_contains(w[i:i + 3], 'the') AND list_contains(w[i:i + 3], 'on'))) > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return search.near(table(s, d, "documents"), ["the", "on"], 4).select("doc_id")


@query("search_wildcard", "SELECT doc_id FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2) AS w FROM documents) WHERE len(list_filter(w, lambda x: regexp_full_match(x, 'th.e.*[ns]'))) > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return search.wildcard(table(s, d, "documents"), "th?e*[ns]").select("doc_id")


@query("search_facets", "SELECT field, value, n FROM (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS r FROM (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE value IS NOT NULL GROUP BY 1, 2) WHERE r <= 3")
def _(s: SparkSession, d: str) -> DataFrame:
    return search.facets(table(s, d, "documents"), ["lang", "source"], 3)


@query("search_fuzzy", "SELECT doc_id FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2) AS w FROM documents) WHERE len(list_filter(w, lambda x: levenshtein(x, 'thing') <= 1)) > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return search.fuzzy(table(s, d, "documents"), "Thing", 1).select("doc_id")


@query("search_suggest", "SELECT term, n, distance FROM (SELECT w AS term, count(*) AS n, levenshtein(w, 'thesn') AS distance FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents) WHERE strlen(w) >= 2 GROUP BY 1) WHERE distance <= 2 ORDER BY distance, n DESC, term LIMIT 5")
def _(s: SparkSession, d: str) -> DataFrame:
    return search.suggest(table(s, d, "documents"), "thesn").withColumn("distance", F.col("distance").cast("long"))


@query("window_sliding", """SELECT epoch_us(w) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts)]) AS w FROM events) GROUP BY 1, 2""")
def _(s: SparkSession, d: str) -> DataFrame:
    w = changes.sliding(table(s, d, "events"), "ts", "1 hour", "30 minutes", ["event_type"], [F.count("*").alias("n")])
    return w.select(micros("window.start").alias("start"), "event_type", "n")


@query("group_first_n", """SELECT o_orderstatus AS _id, (list(o_totalprice ORDER BY o_totalprice)[1:3]) AS lo, (list(o_totalprice ORDER BY o_totalprice DESC)[1:2]) AS hi, (list(o_orderkey ORDER BY o_custkey DESC, o_orderkey)[1:3]) AS top,
max(o_orderkey) FILTER (o_custkey = m) AS low FROM (SELECT *, min(o_custkey) OVER (PARTITION BY o_orderstatus) AS m FROM orders) GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    return pipeline(s, d, "orders", [{"$group": {
        "_id": "$o_orderstatus", "lo": {"$minN": {"n": 3, "input": "$o_totalprice"}}, "hi": {"$maxN": {"n": 2, "input": "$o_totalprice"}},
        "top": {"$topN": {"n": 3, "sortBy": {"o_custkey": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "low": {"$bottom": {"sortBy": {"o_custkey": -1, "o_orderkey": 1}, "output": "$o_orderkey"}},
    }}])


_grid = "(SELECT c_custkey, (c_custkey % 37) / 4.0 AS lng, (c_custkey % 23) / 4.0 AS lat FROM customer)"


def grid(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", F.array((F.col("c_custkey") % 37) / 4.0, (F.col("c_custkey") % 23) / 4.0).alias("p"))


@query("geo_intersects", f"SELECT c_custkey FROM {_grid} WHERE lng BETWEEN 1 AND 3 AND lat BETWEEN 1 AND 4")
def _(s: SparkSession, d: str) -> DataFrame:
    return find(grid(s, d), {"p": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [[[1, 1], [3, 1], [3, 4], [1, 4], [1, 1]]]}}}}).select("c_custkey")


@query("geo_near_sphere", f"SELECT c_custkey, round(m, 3) AS m FROM (SELECT c_custkey, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat - 2) / 2), 2) + cos(radians(lat)) * cos(radians(2)) * pow(sin(radians(lng - 3) / 2), 2))) AS m FROM {_grid}) WHERE m <= 90000 ORDER BY round(m, 3), c_custkey LIMIT 15")
def _(s: SparkSession, d: str) -> DataFrame:
    df = grid(s, d)
    near = geo.nearest(df, of(df).find("p"), {"coordinates": [3, 2], "spherical": True, "$maxDistance": 90_000}, 10_000, "c_custkey")
    return near.select("c_custkey", F.round("distance", 3).alias("m")).orderBy("m", "c_custkey").limit(15)


_jobs = "(SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS state, o_custkey % 5 AS attempts, o_orderdate AS run_at FROM orders)"


def jobs(s: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), state.alias("state"), (F.col("o_custkey") % 5).alias("attempts"), F.col("o_orderdate").alias("run_at"))


@query("job_retries", f"""SELECT id, CASE WHEN state = 'pending' AND id % 3 = 0 THEN CASE WHEN attempts >= 4 THEN 'dead' ELSE 'pending' END ELSE state END AS state,
CASE WHEN state = 'pending' AND id % 3 = 0 THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN state = 'pending' AND id % 3 = 0 AND attempts < 4 THEN epoch_us(TIMESTAMP '1999-01-01') + CAST(pow(2, attempts) * 1000000 AS BIGINT) ELSE epoch_us(CAST(run_at AS TIMESTAMP)) END AS run_at FROM {_jobs}""")
def _(s: SparkSession, d: str) -> DataFrame:
    import datetime

    j = jobs(s, d).withColumn("run_at", F.col("run_at").cast("timestamp"))
    out = stores.failed(j, j.where("state = 'pending' AND id % 3 = 0").select("id"), datetime.datetime(1999, 1, 1, tzinfo=datetime.UTC))
    return out.withColumn("run_at", micros("run_at"))


@query("job_flow", f"SELECT id FROM {_jobs} j WHERE state = 'pending' AND NOT EXISTS (SELECT 1 FROM {_jobs} c WHERE c.id = j.id - 1 AND c.state <> 'done')")
def _(s: SparkSession, d: str) -> DataFrame:
    j = jobs(s, d)
    return stores.ready(j, j.select("id", (F.col("id") - 1).alias("child"))).select("id")


@query("update_bit", "SELECT o_orderkey, (o_custkey & 12) | 1 AS o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    df = find(table(s, d, "orders"), {"$expr": {"$eq": [{"$mod": ["$o_orderkey", 2]}, 0]}})
    return apply_update(apply_update(df, {"$bit": {"o_custkey": {"and": 12}}}), {"$bit": {"o_custkey": {"or": 1}}}).select("o_orderkey", "o_custkey")


@query("version_patch", """WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations) SELECT conv_id, role, text FROM h WHERE v = 2""")
def _(s: SparkSession, d: str) -> DataFrame:
    h = versions.number(table(s, d, "conversations"), "conv_id", ["turn"])
    a, b = h.where("version = 1").select("conv_id", "role", "text"), h.where("version = 2").select("conv_id", "role", "text")
    both = a.join(b.select("conv_id"), "conv_id", "left_semi")
    patch = versions.changes(h.where("version <= 2"), "conv_id", ["role", "text"])
    return versions.apply_diff(both, patch, "conv_id", ["role", "text"]).select("conv_id", "role", "text")


@query("kv_ttl", """WITH l AS (SELECT event_id AS seq, user_id AS key, CASE event_type WHEN 'purchase' THEN 'expire' WHEN 'error' THEN 'del' WHEN 'signup' THEN 'set' ELSE 'incr' END AS op, event_id % 50 * 86400 AS value, epoch_us(ts) AS us FROM events),
e AS (SELECT key, max(seq) FILTER (op = 'expire') AS e, arg_max(us + value * 1000000, seq) FILTER (op = 'expire') AS ends, max(seq) FILTER (op IN ('set', 'del')) AS w FROM l GROUP BY 1)
SELECT key, (ends - (SELECT max(epoch_us(ts)) FROM events)) / 1e6 AS seconds FROM e WHERE e IS NOT NULL AND (w IS NULL OR e > w) AND ends > (SELECT max(epoch_us(ts)) FROM events)""")
def _(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "expire").when(F.col("event_type") == "error", "del").when(F.col("event_type") == "signup", "set").otherwise("incr")
    events = table(s, d, "events")
    log = events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), kind.alias("op"), (F.col("event_id") % 50 * 86_400).alias("value"), "ts")
    return kv.ttl(log, F.lit(events.agg(F.max("ts")).first()[0]))


@query("kv_mget", "SELECT k AS key, c_custkey AS value FROM (SELECT unnest(['Customer#000000003', 'Customer#000000007', 'nobody']) AS k) LEFT JOIN customer ON c_name = k")
def _(s: SparkSession, d: str) -> DataFrame:
    return kv.mget(table(s, d, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value")), ["Customer#000000003", "Customer#000000007", "nobody"])


@query("field_masks", "SELECT c_custkey, repeat('*', greatest(0, length(c_name) - 4)) || right(c_name, 4) AS c_name, sha256(c_mktsegment) AS c_mktsegment FROM customer")
def _(s: SparkSession, d: str) -> DataFrame:
    return stores.masked(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_name": "last4", "c_mktsegment": "hash"})


@query("field_write_rules", "SELECT o_orderkey, 'o_totalprice' AS field FROM orders WHERE o_totalprice > 200000")
def _(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    after = apply_update(apply_update(o, {"$inc": {"o_totalprice": 1}}, {"o_totalprice": {"$gt": 200_000}}), {"$set": {"o_orderstatus": "X"}})
    return stores.refused(o, after, "o_orderkey", {"o_orderstatus"})


@query("zone_map", "SELECT count(*) AS rows, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def _(s: SparkSession, d: str) -> DataFrame:
    zones = kv.may_match(kv.zone_map(table(s, d, "orders"), ["o_orderkey"]), "o_orderkey", lo=10)
    return zones.select("rows", F.col("lo_o_orderkey").alias("lo"), F.col("hi_o_orderkey").alias("hi"))


assert set(ORACLE) <= set(QUERIES)
__all__ = ["BENCH", "FUNCTIONS", "ORACLE", "QUERIES", "compile_filter", "match_group_sort"]
