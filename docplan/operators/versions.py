"""Versions of documents: numbering, time travel, differences and patches, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with `version`: 1 to n for each document."""
    return df.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def latest(history: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("version"))
    return history.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def as_of(history: DataFrame, key: str, version: int) -> DataFrame:
    """Each document at a version, or at its last one before."""
    return latest(history.where(F.col("version") <= version), key)


def _fields(names: list[str]) -> list[str]:
    return [n for n in names if n != "_id" and n != "version" and not n.startswith("__")]


def diff(old: DataFrame, new: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, added, modified, removed): sorted names of the fields that differ. A null field isn't there."""
    a = old.select(key, *[F.col(n).alias(f"a_{n}") for n in names])
    b = new.select(key, *[F.col(n).alias(f"b_{n}") for n in names])
    both = a.join(b, key, "full")

    def which(test) -> Column:
        return F.sort_array(F.filter(F.array(*[F.when(test(F.col(f"a_{n}"), F.col(f"b_{n}")), F.lit(n)) for n in _fields(names)]), lambda x: x.isNotNull()))

    return both.select(key, which(lambda x, y: x.isNull() & y.isNotNull()).alias("added"), which(lambda x, y: x.isNotNull() & y.isNotNull() & (x != y)).alias("modified"), which(lambda x, y: x.isNotNull() & y.isNull()).alias("removed"))


def changes(history: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, version, field, old, new): a row for each field that a version changes, as text. One window over each document."""
    w = Window.partitionBy(key).orderBy("version")
    h = history.select(key, "version", *[F.struct(F.lag(n).over(w).cast("string").alias("old"), F.col(n).cast("string").alias("new")).alias(n) for n in _fields(names)])
    rows = h.select(key, "version", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).getField("old").alias("old"), F.col(n).getField("new").alias("new")) for n in _fields(names)])).alias("c"))
    return rows.select(key, "version", "c.*").where(~F.col("old").eqNullSafe(F.col("new")) & (F.col("version") > 1))


def apply_diff(df: DataFrame, patch: DataFrame, key: str, names: list[str], reverse: bool = False) -> DataFrame:
    """df with a patch of changes() applied: each field's new value, or its old one in reverse."""
    side = "old" if reverse else "new"
    wide = patch.groupBy(key).pivot("field", names).agg(F.first(F.struct(F.lit(True).alias("hit"), F.col(side).alias("v"))))
    out = df.join(wide.select(key, *[F.col(f"`{n}`").alias(f"p_{n}") for n in names]), key, "left")
    return out.select(*[F.when(F.col(f"p_{c}").isNotNull(), F.col(f"p_{c}").getField("v").cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def prune(history: DataFrame, key: str, keep: int) -> DataFrame:
    """The last versions of each document."""
    w = Window.partitionBy(key).orderBy(F.desc("version"))
    return history.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")
