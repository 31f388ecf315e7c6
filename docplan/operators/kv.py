"""Key-value stores as logs of operations, replayed with windows: what a store holds after them, without a loop over them.

A log has seq, key, op, and value for numbers; hashes have field besides. Operations: set, setnx (only where there is nothing), incr,
del, expire (value: seconds from ts). An incr of what isn't there starts from 0."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import micros
from .stores import glob


def replay(log: DataFrame, by: list[str], now: Column | None = None) -> DataFrame:
    """(by, value): what is there after all operations; what has expired by `now` is gone."""
    w = Window.partitionBy(*by).orderBy("seq")
    writes = log.where(F.col("op") != "expire")
    was = F.lag("op").over(w)
    fresh = was.isNull() | (was == "del")  # after anything else there is a value
    writes = writes.withColumn("__reset", F.col("op").isin("set", "del") | (F.col("op") == "setnx") & fresh)
    writes = writes.where(F.col("__reset") | (F.col("op") == "incr"))
    writes = writes.withColumn("__life", F.sum(F.col("__reset").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lives = writes.groupBy(*by, "__life").agg(F.max_by("op", F.when(F.col("__reset"), F.col("seq"))).alias("__op"), F.sum(F.when(F.col("op") != "del", F.col("value")).otherwise(0)).alias("value"), F.count_if(F.col("op") == "incr").alias("__incr"), F.min("seq").alias("__from"))
    last = lives.groupBy(*by).agg(F.max_by(F.struct("__op", "value", "__incr", "__from"), "__life").alias("s"))
    there = last.where((F.col("s.__op").isNull()) | (F.col("s.__op") != "del") | (F.col("s.__incr") > 0)).select(*by, F.col("s.value").alias("value"), F.col("s.__from").alias("__from"))
    if now is None:
        return there.drop("__from")
    ends = log.where("op = 'expire'").groupBy(*by).agg(F.max_by(F.struct("seq", (micros("ts") + F.col("value") * 1_000_000).alias("at")), "seq").alias("e"))
    kept = there.join(ends, by, "left").where(F.col("e").isNull() | (F.col("e.seq") < F.col("__from")) | (F.col("e.at") > micros(now)))
    return kept.drop("__from", "e")


def mget(store: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value): a row for each key asked for, in any order, null where there is none. The keys are few, and are broadcast."""
    asked = store.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
    mine = store.where(F.col("key").cast("string").isin(list(dict.fromkeys(keys)))).select(F.col("key").cast("string").alias("key"), "value")
    return asked.join(mine, "key", "left")


def ttl(log: DataFrame, now: Column) -> DataFrame:
    """(key, seconds): how long each key that has an end still lives; a write behind an expire takes its end away, incr doesn't."""
    last = log.groupBy("key").agg(
        F.max(F.when(F.col("op") == "expire", F.struct("seq", (micros("ts") + F.col("value") * 1_000_000).alias("at")))).alias("e"), F.max(F.when(F.col("op").isin("set", "setnx", "del"), F.col("seq"))).alias("w")
    )
    left = (F.col("e.at") - micros(now)) / 1e6
    return last.where(F.col("e").isNotNull() & (F.col("w").isNull() | (F.col("e.seq") > F.col("w"))) & (left > 0)).select("key", left.alias("seconds"))


def token_bucket(events: DataFrame, by: str, time: str, tiebreak: str, rate: float, burst: float) -> DataFrame:
    """(by, tiebreak, allowed): each event takes a token of its key's bucket, which fills by `rate` a second up to `burst`. A bucket's
    level depends on all that came before, which no window expresses: keys are dealt out and sorted, and a task folds its rows as they
    stream by, holding one level, however long a key's history is. Events without a time come first and fill nothing."""
    rows = events.select(F.col(by).alias("by"), (micros(time) / 1e6).alias("at"), F.col(tiebreak).alias("id"))
    dealt = rows.repartition("by").sortWithinPartitions("by", F.asc_nulls_first("at"), "id")
    out = T.StructType([T.StructField("by", rows.schema["by"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("allowed", T.BooleanType())])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, level, last = object(), 0.0, None
        for b in batches:
            allowed = []
            for k, at in zip(b.column("by").to_pylist(), b.column("at").to_pylist(), strict=True):
                if k != key:
                    key, level, last = k, float(burst), None
                if at is not None and last is not None:
                    level = min(float(burst), level + (at - last) * rate)
                last = at if at is not None else last
                allowed.append(level >= 1)
                level -= allowed[-1]
            yield pa.RecordBatch.from_arrays([b.column("by"), b.column("id"), pa.array(allowed)], names=["by", "id", "allowed"])

    return dealt.mapInArrow(fold, out).select(F.col("by").alias(by), F.col("id").alias(tiebreak), "allowed")


def lists(log: DataFrame) -> DataFrame:
    """(key, values): what lists hold after pushes. log: seq, key, op (lpush, rpush, del) and value; a push on the left goes before all
    that is there."""
    w = Window.partitionBy("key")
    alive = log.withColumn("__del", F.max(F.when(F.col("op") == "del", F.col("seq"))).over(w)).where((F.col("op") != "del") & (F.col("__del").isNull() | (F.col("seq") > F.col("__del"))))
    place = F.when(F.col("op") == "lpush", -F.col("seq")).otherwise(F.col("seq"))
    return alive.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("value").alias("v")))), lambda x: x["v"]).alias("values"))


def list_range(stored: DataFrame, start: int, stop: int) -> DataFrame:
    """The values from start to stop, both included; negative places count from the end."""
    n = F.size("values")
    a = F.greatest(F.lit(0), F.lit(start) if start >= 0 else n + start)
    b = F.least(n - 1, F.lit(stop) if stop >= 0 else n + stop)
    return stored.withColumn("values", F.when(b >= a, F.slice("values", a + 1, F.greatest(F.lit(0), b - a + 1))).otherwise(F.slice("values", 1, 0)))


def published(messages: DataFrame, channels: list[str]) -> DataFrame:
    """messages with `receivers`: the subscribed channels and patterns that match each one's channel, and how many (`delivered`)."""
    hits = F.array(*[F.when(F.col("channel").rlike(glob(c)), F.lit(c)) for c in channels]) if channels else F.array().cast("array<string>")
    return messages.withColumn("receivers", F.array_compact(hits)).withColumn("delivered", F.size("receivers"))


def with_ids(df: DataFrame, kind: str = "uuid", name: str = "_id", start: int = 1, node: int = 0) -> DataFrame:
    """Identifiers: uuid; snowflake (41 bits of milliseconds, 10 of the node, 12 of a count); increment (unique and rising, with gaps
    between partitions, so that no task numbers all rows).

    A snowflake's node is five bits of the writer (`node`, 0 to 31) and five of the partition; partitions beyond 32, and rows beyond
    4,096 of a millisecond, go to later milliseconds, each 32 partitions to a span of 2 ** 21 of them, as many as a partition can fill.
    So identifiers of one run are unique however many there are; runs at the same time need nodes of their own."""
    if kind == "uuid":
        return df.withColumn(name, F.uuid())
    if kind == "increment":
        return df.withColumn(name, F.monotonically_increasing_id() + F.lit(start))
    if kind == "snowflake":
        if not 0 <= node < 32:
            raise ValueError("node is 0 to 31")
        n = F.monotonically_increasing_id()
        row, part = n.bitwiseAND((1 << 33) - 1), F.shiftright(n, 33)
        ms = F.unix_millis(F.current_timestamp()) - 1_577_836_800_000 + F.shiftright(part, 5) * (1 << 21) + F.shiftright(row, 12)
        return df.withColumn(name, F.shiftleft(ms, 22) + F.lit(node << 17) + F.shiftleft(part.bitwiseAND(31), 12) + row.bitwiseAND(4095))
    raise ValueError(f"unknown kind {kind}")


def zone_map(df: DataFrame, columns: list[str]) -> DataFrame:
    """(file, rows, and lo_/hi_ of each column): what a range test can skip files by."""
    ends = [f(c).alias(f"{p}_{c}") for c in columns for f, p in ((F.min, "lo"), (F.max, "hi"))]
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), *ends)


def may_match(zones: DataFrame, column: str, lo=None, hi=None) -> DataFrame:
    """The files that may hold values of a range."""
    out = zones
    if lo is not None:
        out = out.where(F.col(f"hi_{column}") >= F.lit(lo))
    return out if hi is None else out.where(F.col(f"lo_{column}") <= F.lit(hi))
