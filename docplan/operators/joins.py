"""Full joins whose groups may be of any size.

Spark's own full join holds the rows that a key has on both sides, and in compiled code all their pairs, in memory at once. Here keys with
many rows are cut into pieces on both sides, and each piece of one side meets each of the other: a task holds pieces, not groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key in a piece, about. Fixed value: two pieces make 17 million pairs, and a row is held with its pairs in one piece.
PIECE = 4096
#: Values that can be hashed.
PLAIN = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def in_pieces(df: DataFrame, key: str) -> DataFrame:
    """Keys with more rows than a piece, one for each PIECE rows of df at most, and the number of their pieces."""
    return df.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("__n")).where("__n > 1")


def cut(df: DataFrame, key: str, mine: DataFrame, theirs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """df with two columns more: the piece of a row, and a row for each piece that the other side has of its key. The piece depends on the
    row's values alone, so a task that runs again deals as before; rows that are equal in all plain columns stay together."""
    values = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, PLAIN)]
    m, t = mine.toDF("__mine", "__m"), theirs.toDF("__theirs", "__t")
    counted = df.join(F.broadcast(m), df[f"`{key}`"] == m["__mine"], "left").join(F.broadcast(t), df[f"`{key}`"] == t["__theirs"], "left")
    piece = F.when(F.col("__m").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(F.lit(0), *values), F.col("__m")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__t"), F.lit(1)).cast("long") - 1))
    return counted.select(*[F.col(f"`{c}`") for c in df.columns], piece.alias(names[0]), each.alias(names[1]))


def pairs(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs of rows with equal keys."""
    a, b = df.schema[left].dataType, other.schema[right].dataType
    if a != b and not (isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)):
        return df.join(other, df[f"`{left}`"] == other[f"`{right}`"])  # the comparison alone knows which keys are equal: groups stay whole
    m, n, kind = in_pieces(df, left), in_pieces(other, right), a if a == b else T.LongType()
    # dealt by number: how many rows come out doesn't show in how many go in, so Spark would put all pieces into few tasks
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = cut(df, left, m, n, ("__i", "__j")).repartition(parts, F.col(f"`{left}`").cast(kind), "__i", "__j")
    y = cut(other, right, n, m, ("__l", "__k")).repartition(parts, F.col(f"`{right}`").cast(kind), "__k", "__l")
    both = x.join(y, (x[f"`{left}`"] == y[f"`{right}`"]) & (x["__i"] == y["__k"]) & (x["__j"] == y["__l"]))
    return both.drop("__i", "__j", "__k", "__l")


def alone(df: DataFrame, other: DataFrame, key: str, others: str) -> DataFrame:
    """The rows of df whose key is null or isn't there."""
    keys = other.select(F.col(f"`{others}`").alias("__key")).distinct()
    return df.join(keys, df[f"`{key}`"] == keys["__key"], "left_anti")


def full_join(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs of rows with equal keys, and the rows of either side that have none. No name is on both sides."""

    def nulls(x: DataFrame) -> list[Column]:
        return [F.lit(None).cast(f.dataType).alias(f.name) for f in x.schema]

    rest = alone(df, other, left, right).select("*", *nulls(other)), alone(other, df, right, left).select(*nulls(df), "*")
    return pairs(df, other, left, right).union(rest[0]).union(rest[1])
