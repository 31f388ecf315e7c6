"""Change streams: a log of changes as a streaming source, watching it, and views kept by it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.filters import compile_filter
from ..functions.paths import of
from ..sources.files import exists

#: A change: its number, kind, collection and document.
SCHEMA = "seq long, op string, ns string, key string, document string, before string, ts timestamp"
#: As the log stores it: i counts from the number that the folder's name tells.
STORED = "i long, op string, ns string, key string, document string, before string, ts timestamp"


def numbered(log: DataFrame) -> DataFrame:
    """With `seq`: the first number of the folder, and the change's place behind it."""
    first = F.regexp_extract(F.col("_metadata.file_path"), r"/c(\d{20})/[^/]*$", 1).cast("long")
    return log.select((first + F.col("i")).alias("seq"), "op", "ns", "key", "document", "before", "ts")


def read_since(spark: SparkSession, path: str, seq: int = 0, ns: str | None = None) -> DataFrame:
    """Changes from a number on, in order."""
    log = numbered(spark.read.schema(STORED).parquet(f"{path}/c*")).where(F.col("seq") >= seq) if exists(spark, path) else spark.createDataFrame([], SCHEMA)
    return (log if ns is None else log.where(F.col("ns") == ns)).orderBy("seq")


def stream(spark: SparkSession, path: str, ns: str | None = None, since: int = 0, where: Any = None) -> DataFrame:
    """The log as a stream; of one collection, from a resume point, where a filter on the change holds."""
    log = numbered(spark.readStream.schema(STORED).parquet(f"{path}/c*")).where(F.col("seq") >= since)
    if ns is not None:
        log = log.where(F.col("ns") == ns)
    return log if where is None else log.where(compile_filter(of(log), where))


def watch(changes: DataFrame, callback: Callable[[dict], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Calls back for each change, in order within a batch. once: what there is, then it ends."""

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("seq").toLocalIterator():
            callback(row.asDict())

    w = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(availableNow=True) if once else w).start()


def _late(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark; None where the stream has one."""
    return events if late is None else events.withWatermark(time, late)


def tumbling(events: DataFrame, time: str, width: str, by: list[str], aggregates: list, late: str | None = "10 minutes") -> DataFrame:
    """Aggregates over windows of fixed width; rows later than the watermark are left out of a stream."""
    return _late(events, time, late).groupBy(F.window(time, width), *by).agg(*aggregates)


def sliding(events: DataFrame, time: str, width: str, slide: str, by: list[str], aggregates: list, late: str | None = "10 minutes") -> DataFrame:
    return _late(events, time, late).groupBy(F.window(time, width, slide), *by).agg(*aggregates)


def session(events: DataFrame, time: str, gap: str, by: list[str], aggregates: list, late: str | None = "10 minutes") -> DataFrame:
    """Windows that end with a silence of the gap: a counter that each hit keeps alive."""
    return _late(events, time, late).groupBy(F.session_window(time, gap), *by).agg(*aggregates)


def deduplicate(events: DataFrame, time: str, by: list[str], within: str = "10 minutes") -> DataFrame:
    """The first event of each key while the watermark remembers it."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(by)


def state_of(changes: DataFrame) -> DataFrame:
    """(key, document): what a log leaves, by each key's last change."""
    last = changes.groupBy("ns", "key").agg(F.max_by(F.struct("op", "document"), "seq").alias("c"))
    return last.where("c.op <> 'delete'").select("ns", "key", F.col("c.document").alias("document"))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed rows between two results of a query."""
    names = [c for c in old.columns if c != key]
    a = old.select(F.col(key), F.struct(*names).alias("__a"))
    b = new.select(F.col(key), F.struct(*names).alias("__b"))
    both = a.join(b, key, "full")
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select(key, kind.alias("change")).where("change IS NOT NULL")


def keep_sum(changes: DataFrame, by: str, amount: str, target: str, checkpoint: str, merge: Callable[[DataFrame], None]) -> StreamingQuery:
    """Feeds each batch's sums by key to merge(), which adds them to a materialised view."""

    def each(batch: DataFrame, _: int) -> None:
        merge(batch.groupBy(by).agg(F.sum(amount).alias(target), F.count("*").alias("n")))

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
