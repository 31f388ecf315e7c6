"""Key-value, sorted-set, queue and log queries over tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---- sorted sets: (key, member, score)


def ranked(sets: DataFrame, reverse: bool = False) -> DataFrame:
    """With `rank`, from 0, by score and member; reversed from the highest on."""
    order = [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]
    return sets.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1)


def z_range(sets: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members by rank from start to stop, both included; negative ones count from the end."""
    r = ranked(sets, reverse).withColumn("__n", F.count("*").over(Window.partitionBy("key")))
    a = F.lit(start) if start >= 0 else F.greatest(F.lit(0), F.col("__n") + start)
    b = F.lit(stop) if stop >= 0 else F.col("__n") + stop
    return r.where((F.col("rank") >= a) & (F.col("rank") <= b)).drop("__n")


def z_range_by_score(sets: DataFrame, lo: float, hi: float) -> DataFrame:
    return sets.where((F.col("score") >= lo) & (F.col("score") <= hi))


def leaderboard(sets: DataFrame, n: int) -> DataFrame:
    """The n best of each key, rank from 1, ties by member."""
    w = Window.partitionBy("key").orderBy(F.desc("score"), "member")
    return sets.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def global_leaderboard(sets: DataFrame, prefix: str, n: int) -> DataFrame:
    """(member, score, groups): the n best sums over all keys with a prefix."""
    return sets.where(F.col("key").startswith(prefix)).groupBy("member").agg(F.sum("score").alias("score"), F.count("*").alias("groups")).orderBy(F.desc("score"), "member").limit(n)


# ---- keys and values: (key, value, expires_at)


def glob(pattern: str) -> str:
    """The regular expression of *, ? and [...]."""
    out = "".join(".*" if p == "*" else "." if p == "?" else p if p.startswith("[") else re.escape(p) for p in re.findall(r"\[[^\]]*\]|.", pattern, re.S))
    return f"^{out}$"


def keys(store: DataFrame, pattern: str = "*", now=None) -> DataFrame:
    alive = store if now is None or "expires_at" not in store.columns else store.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))
    return alive.where(F.col("key").rlike(glob(pattern))).select("key")


def scan(store: DataFrame, cursor: str = "", count: int = 10, pattern: str = "*") -> DataFrame:
    """The next keys behind a cursor, in order."""
    return keys(store, pattern).where(F.col("key") > cursor).orderBy("key").limit(count)


# ---- queues: (id, state, priority, run_at, created_at)


def pop_candidates(jobs: DataFrame, now, n: int = 5) -> DataFrame:
    """Jobs that may run, the most urgent first."""
    due = jobs.where(F.col("state").isin("pending", "retrying") & (F.col("run_at") <= F.lit(now)))
    return due.orderBy("priority", "run_at", "created_at", "id").limit(n)


def queue_metrics(jobs: DataFrame) -> DataFrame:
    """processed, failed, retried, expired and the rounded mean latency of what was processed."""
    def n(state: str):
        return F.count_if(F.col("state") == state)

    return jobs.agg(n("processed").alias("processed"), n("failed").alias("failed"), n("retrying").alias("retried"), n("expired").alias("expired"), F.round(F.avg(F.when(F.col("state") == "processed", F.col("latency_ms")))).cast("long").alias("latency"))


def audit(log: DataFrame, op: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first."""
    return (log if op is None else log.where(F.col("op") == op)).orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def visible(df: DataFrame, readable: set[str]) -> DataFrame:
    """Only the fields that may be read."""
    return df.select(*[c for c in df.columns if c in readable])


def masked(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Fields as a reader may see them: hide makes them null, hash gives their SHA-256, last4 all but the last four characters starred."""
    new = {}
    for name, rule in rules.items():
        text = F.col(f"`{name}`").cast("string")
        n = F.greatest(F.lit(0), F.char_length(text) - 4)
        if rule not in ("hide", "hash", "last4"):
            raise ValueError(f"unknown rule {rule}")
        new[name] = F.lit(None).cast(df.schema[name].dataType) if rule == "hide" else F.sha2(text.cast("binary"), 256) if rule == "hash" else F.concat(F.repeat(F.lit("*"), n), F.substr(text, n + 1))
    return df.withColumns(new)


def refused(before: DataFrame, after: DataFrame, key: str, writable: set[str]) -> DataFrame:
    """(key, field): changes to fields that may not be written; none if a write may pass."""
    fields = [c for c in before.columns if c != key and c not in writable and c in after.columns]
    a, b = before.select(key, *[F.col(c).alias(f"a_{c}") for c in fields]), after.select(key, *[F.col(c).alias(f"b_{c}") for c in fields])
    hit = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in fields])) if fields else F.array().cast("array<string>")
    return a.join(b, key).select(key, F.explode(hit).alias("field"))


# ---- sets of rows


def union(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    out = a.unionByName(b, allowMissingColumns=True)
    return out if all_ else out.distinct()


def intersect(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    return a.intersectAll(b) if all_ else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    return a.exceptAll(b) if all_ else a.subtract(b)


def infer_schema(df: DataFrame) -> DataFrame:
    """(field, type, present, nulls, distinct, low, high): one pass over all rows; distinct is approximate."""
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        text = c.cast("string") if f.dataType.simpleString().split("<")[0] not in ("array", "struct", "map") else F.to_json(c)
        parts.append(F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.count(c).alias("present"), F.count_if(c.isNull()).alias("nulls"), F.approx_count_distinct(text).alias("distinct"), F.min(text).alias("low"), F.max(text).alias("high")))
    return df.agg(F.array(*parts).alias("f")).select(F.explode("f").alias("f")).select("f.*")


# ---- jobs: (id, state, attempts, run_at, ...)


def failed(jobs: DataFrame, ids: DataFrame, now, most: int = 5, base: float = 1.0, factor: float = 2.0, limit: float = 3600.0) -> DataFrame:
    """The jobs once those of `ids` have failed: one more attempt, and pending again after base * factor ** attempts seconds, `limit` at
    most; with the last attempt they are dead."""
    hit = jobs.join(ids.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left").withColumn("__hit", F.col("__id").isNotNull()).drop("__id")
    tries = F.col("attempts") + 1
    wait = F.least(F.lit(limit), F.lit(base) * F.pow(F.lit(factor), F.col("attempts")))
    later = F.timestamp_micros((F.unix_micros(F.lit(now).cast("timestamp")) + wait * 1_000_000).cast("long"))
    return hit.withColumns({
        "state": F.when(F.col("__hit"), F.when(tries >= most, "dead").otherwise("pending")).otherwise(F.col("state")),
        "run_at": F.when(F.col("__hit") & (tries < most), later).otherwise(F.col("run_at")),
        "attempts": F.when(F.col("__hit"), tries).otherwise(F.col("attempts")),
    }).drop("__hit")


def dead_letters(jobs: DataFrame) -> DataFrame:
    return jobs.where("state = 'dead'")


def ready(jobs: DataFrame, needs: DataFrame) -> DataFrame:
    """Pending jobs of a flow all of whose children are done. needs: id, child."""
    open_ = needs.join(jobs.where("state <> 'done'").select(F.col("id").alias("child")), "child", "left_semi").select("id").distinct()
    return jobs.where("state = 'pending'").join(open_, "id", "left_anti")


def claim(jobs: DataFrame, n: int, now, worker: str) -> DataFrame:
    """All jobs, the next n of the queue as running and the worker's. Written back in a transaction, a claim is the worker's alone."""
    mine = pop_candidates(jobs, now, n).select(F.col("id").alias("__id"))
    out = jobs.join(F.broadcast(mine), F.col("id") == F.col("__id"), "left")  # n rows
    owner = F.col("owner") if "owner" in jobs.columns else F.lit(None).cast("string")
    return out.withColumns({"state": F.when(F.col("__id").isNotNull(), "running").otherwise(F.col("state")), "owner": F.when(F.col("__id").isNotNull(), worker).otherwise(owner)}).drop("__id")
