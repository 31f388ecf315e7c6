"""SELECT statements beyond the document dialect: Spark SQL over collections.

CTEs, subqueries, set operations, CASE and other expressions, functions, windows, grouping sets, joins with any condition, UNNEST, NULLS
FIRST and LAST, all with SQL's three-valued logic, are Catalyst's own. Collections become temporary views while a statement is analysed,
and a user's views of the same names come back after it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .select import run_select
from .sql import Select, SqlError, parse, tokens

#: What a SELECT of the document dialect never has: with one of these a statement is Spark SQL.
BEYOND = frozenset(("WITH", "UNION", "INTERSECT", "EXCEPT", "MINUS", "CASE", "OVER", "NULLS", "UNNEST", "LATERAL", "USING", "CAST", "EXISTS", "ROLLUP", "CUBE", "GROUPING", "QUALIFY", "WINDOW", "FILTER", "ANY", "ALL", "VALUES"))


def names_of(text: str) -> set[str]:
    """The words and quoted names of a statement, lower case."""
    return {m[0].strip("`\"").lower() for m in re.finditer(r"`[^`]+`|\"[^\"]+\"|[A-Za-z_]\w*", re.sub(r"'(?:[^']|'')*'", "''", text))}


def beyond(text: str) -> bool:
    """Whether a statement has a word that the document dialect doesn't."""
    try:
        return any(t.kind == "word" and t.value.upper() in BEYOND for t in tokens(text))
    except SqlError:
        return True


@contextmanager
def views(spark: SparkSession, tables: dict[str, DataFrame]) -> Iterator[None]:
    """The tables as temporary views, and then those that were there before."""
    was = {n: spark.table(n) for n in tables if spark.catalog.tableExists(n) and any(t.name.lower() == n.lower() and t.isTemporary for t in spark.catalog.listTables())}
    try:
        for n, df in tables.items():
            df.createOrReplaceTempView(n)
        yield
    finally:
        for n in tables:
            spark.catalog.dropTempView(n)
        for n, df in was.items():
            df.createOrReplaceTempView(n)


def unnested(text: str) -> str:
    """unnest(x) as Spark has it: explode in a list of columns, a table function in FROM."""
    return re.sub(r"\bunnest\s*\(", "explode(", text, flags=re.I)


def run_ansi(spark: SparkSession, text: str, table: Callable[[str], DataFrame], known: Iterable[str], params: Any = None) -> DataFrame:
    """A SELECT over the collections among `known` that it names. params: a list for ?, a dict for :name."""
    used = names_of(text)
    with views(spark, {n: table(n) for n in known if n.lower() in used}):
        return spark.sql(unnested(text), args=params or None)  # analysed here, so the views may go


def select(spark: SparkSession, text: str, table: Callable[[str], DataFrame], known: Iterable[str], params: Any = None) -> DataFrame:
    """The rows of a SELECT: by the document dialect where it knows the statement, else by Spark SQL. What neither knows is an error."""
    why = None
    if not beyond(text):
        try:
            q = parse(text, params)
        except SqlError as e:
            why = e
        else:
            if not isinstance(q, Select):
                raise SqlError("expected a SELECT")
            return run_select(q, table)
    try:
        return run_ansi(spark, text, table, known, params)
    except AnalysisException as e:  # or it can't be parsed
        if why is not None:
            raise why from e
        raise
