"""Functions, accumulators, stages, validators and tokenizers of one's own, by name.

A scalar function gets and gives columns; one of Python values is wrapped as a vectorised UDF, which takes whole batches. An accumulator
gets the group's values of its argument as a column and gives an aggregate; one of Python values folds the values gathered by group. A
stage gets the rows and its specification and gives rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import accumulators, expressions

VALIDATORS: dict[str, Callable[[dict], bool]] = {}
TOKENIZERS: dict[str, Callable[[Column], Column]] = {}


def _named(name: str, taken: Any, replace: bool) -> str:
    name = name if name.startswith("$") else f"${name}"
    if name in taken and not replace:
        raise ValueError(f"{name} is there already")
    return name


def function(name: str, f: Callable[..., Column], replace: bool = False) -> None:
    """f of columns: an expression of Spark's functions stays in generated code."""
    name = _named(name, expressions.FUNCTIONS, replace)
    expressions.FUNCTIONS[name] = lambda a: f(*a)


def python_function(name: str, f: Callable[..., pd.Series], returns: str, replace: bool = False) -> None:
    """f of pandas Series, batch by batch."""
    udf = F.pandas_udf(f, returns)
    function(name, lambda *a: udf(*a), replace)


def accumulator(name: str, f: Callable[[Column], Column], replace: bool = False) -> None:
    """f makes an aggregate of a column, such as F.sum(F.pow(c, 2))."""
    accumulators.CUSTOM[_named(name, accumulators.CUSTOM, replace)] = f


def folded(start: Any, merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, kind: str | None = None) -> Callable[[Column], Column]:
    """An accumulator by a start, a step and an end, over the values of a group in the order in which they are gathered. The group is in
    one array; aggregates of Spark's have no such bound."""
    first = F.lit(start) if kind is None else F.lit(start).cast(kind)
    return lambda c: F.aggregate(F.collect_list(c), first, merge, finish) if finish else F.aggregate(F.collect_list(c), first, merge)


def stage(name: str, f: Callable[[DataFrame, Any], DataFrame], replace: bool = False) -> None:
    from ..operators.pipeline import STAGES

    STAGES[_named(name, STAGES, replace)] = lambda s, spec: f(s.df, spec)


def validator(name: str, f: Callable[[dict], bool]) -> None:
    """f tells of a document whether it may be inserted; collections name their validators."""
    VALIDATORS[name] = f


def tokenizer(name: str, f: Callable[[Column], Column]) -> None:
    """f makes an array of tokens of a text column."""
    TOKENIZERS[name] = f


def drop(name: str) -> bool:
    """Whether there was something of that name."""
    from ..operators.pipeline import STAGES

    places = (expressions.FUNCTIONS, accumulators.CUSTOM, STAGES, VALIDATORS, TOKENIZERS)
    return any([place.pop(n, None) is not None for place in places for n in (name, f"${name}")])
