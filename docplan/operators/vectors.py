"""Exact vector search."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import cosine, dot, l2
from ..functions.filters import compile_filter
from ..functions.paths import of


def vector_search(df: DataFrame, vector: list[float], k: int, column: str = "embedding", key: str = "vec_id", metric: str = "cosine", where: Any = None) -> DataFrame:
    """The k rows nearest to a vector, with score, best first; ties by key. cosine: -1 for another length, 0 without length. l2 scores
    are negative distances. The filter comes first. One pass with a bounded heap in each task."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    c = F.col(column)
    if where:
        df = df.where(compile_filter(of(df), where))
    if metric == "cosine":
        score = cosine(c, q)
    elif metric == "dot":
        score = dot(c, q)
    elif metric == "l2":
        score = -l2(c, q)
    else:
        raise ValueError(f"unknown metric {metric}")
    return df.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)
