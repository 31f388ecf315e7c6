"""Relations between collections: populated lookups, integrity, and what deletes and key changes carry along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """Rows refer to what isn't there."""


def populate(df: DataFrame, other: DataFrame, local: str, foreign: str, name: str, one: bool = False) -> DataFrame:
    """df with the matching rows nested; with `one` the smallest match, or null."""
    rows = F.struct(*[F.col(f"`{c}`") for c in other.columns])
    keys = df.select(F.col(local).alias("__asked")).where("__asked IS NOT NULL").distinct()
    other = other.join(keys, F.col(foreign) == F.col("__asked"), "left_semi")  # only rows that some row asks for are gathered
    many = other.groupBy(F.col(foreign).alias("__key")).agg((F.min(rows) if one else F.sort_array(F.collect_list(rows))).alias(name))
    out = df.join(many, df[local] == many["__key"], "left").drop("__key")
    return out if one else out.withColumn(name, F.coalesce(F.col(name), F.array().cast(many.schema[name].dataType)))


def violations(df: DataFrame, other: DataFrame, local: str, foreign: str) -> DataFrame:
    """Rows whose key isn't null and isn't there."""
    keys = other.select(F.col(foreign).alias("__key")).distinct()
    return df.where(F.col(local).isNotNull()).join(keys, F.col(local) == F.col("__key"), "left_anti")


def validate(df: DataFrame, other: DataFrame, local: str, foreign: str, mode: str = "strict") -> DataFrame:
    """mode off: df; soft: df with `valid`; strict: df, or an error where a row violates the relation."""
    if mode == "off":
        return df
    if mode == "soft":
        keys = other.select(F.col(foreign).alias("__key")).distinct()
        return df.join(keys, F.col(local) == F.col("__key"), "left").withColumn("valid", F.col(local).isNull() | F.col("__key").isNotNull()).drop("__key")
    if violations(df, other, local, foreign).take(1):
        raise IntegrityError(f"{local} refers to rows without {foreign}")
    return df


def on_delete(children: DataFrame, gone: DataFrame, local: str, foreign: str, action: str = "cascade") -> DataFrame:
    """The children once their parents are gone. cascade deletes them, set_null clears their key, restrict is an error if there are any."""
    keys = gone.select(F.col(foreign).alias("__key")).distinct()
    if action == "cascade":
        return children.join(keys, F.col(local) == F.col("__key"), "left_anti")
    if action == "set_null":
        out = children.join(keys, F.col(local) == F.col("__key"), "left")
        return out.withColumn(local, F.when(F.col("__key").isNull(), F.col(local))).drop("__key")
    if action == "restrict":
        if children.join(keys, F.col(local) == F.col("__key"), "left_semi").take(1):
            raise IntegrityError(f"rows still refer to {foreign}")
        return children
    raise ValueError(f"unknown action {action}")


def on_update(children: DataFrame, changed: DataFrame, local: str, old: str = "old", new: str = "new") -> DataFrame:
    """The children with keys that changed carried along. changed: old and new key, one row for each old one."""
    pairs = changed.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    out = children.join(pairs, F.col(local) == F.col("__old"), "left")
    return out.withColumn(local, F.when(F.col("__old").isNotNull(), F.col("__new")).otherwise(F.col(local))).drop("__old", "__new")
