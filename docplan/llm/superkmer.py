"""Removal of repeated passages by super-k-mer partitioning.

A window is `window` consecutive words; its minimiser is the least hash of the `seed`-word runs in it. Consecutive windows of a text
that share their minimiser make a super-k-mer, which travels as one packed string of words to the bucket of its minimiser; there its
windows are laid out, sorted and counted as the words they are. Equal windows have equal minimisers, so each bucket counts its windows
for good.

Three things keep this small. A minimiser that stands at one place of the whole corpus has no repeated window, so hashes travel first and
strings only for minimisers that occur again. Equal texts are one text with a weight, and equal strings one string, before anything is
dealt out. And a minimiser with more than `hot` different strings is dealt out by whole windows instead, so no bucket is unbounded.

Null and empty texts have no words. Very long texts are cut whole; batches are bounded by bytes, so memory grows with the longest text
alone. Texts shorter than a window, and rows without a repeated window, lose nothing. Rows may repeat, also
with equal identifiers: a text that occurs twice repeats all its windows. An empty table gives an empty result; other columns are
ignored."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, kind_of, map_frames, map_text, partitions, stored, struct, texts

WINDOW = 35
SEED = 12
#: Windows of a packed string at most; longer runs of one minimiser are cut.
STRING = 256
#: Strings of a bucket; larger ones are dealt out by window.
HOT = 2000

#: Columns that cut_repeats adds for a while; no table's own.
KEY, RANGES = "__docplan_key", "__docplan_ranges"

words = re.compile(r"[^\x20\x09-\x0D]+").findall


def flat_words(many: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all texts, and where each text's begin, with the end."""
    split = [words(t) for t in many]
    starts = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(x) for x in split], out=starts[1:])
    return [w for x in split for w in x], starts


def hashes(flat: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no order of sums."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive numbers."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return mixed(out)


def sliding_least(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least of each k consecutive numbers, and its first and last place there, by doubling."""
    first = last = np.arange(len(x))
    size = 1
    while size < k:
        step = min(size, k - size)
        a, b = x[:-step], x[step:]
        first = np.where(b < a, first[step:], first[:-step])
        last = np.where(b <= a, last[step:], last[:-step])
        x = np.minimum(a, b)
        size += step
    return x, first, last


def super_kmers(many: list[str], window: int = WINDOW, seed: int = SEED, most: int = STRING) -> tuple[np.ndarray, ...]:
    """Text number, first word, number of windows and minimiser of the super-k-mers of texts, in order, and whether the minimiser stands
    at more than one place of it: only then can its own windows be equal."""
    flat, starts = flat_words(many)
    n = len(flat) - window + 1
    nothing = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, bool))
    if n < 1:
        return nothing
    least, first_at, last_at = sliding_least(runs(hashes(flat), seed), window - seed + 1)
    owner = np.repeat(np.arange(len(many)), np.diff(starts))[:n]
    at = np.arange(n)
    whole = at + window <= starts[owner + 1]
    at, owner, least, first_at, last_at = at[whole], owner[whole], least[whole], first_at[whole], last_at[whole]
    if not len(at):
        return nothing
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - first) % most == 0
    cut = np.flatnonzero(new)
    return owner[cut], at[cut] - starts[owner[cut]], np.diff(np.append(cut, len(at))), least[cut], np.minimum.reduceat(first_at, cut) != np.maximum.reduceat(last_at, cut)


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return texts(df, key, text).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))


def _scan(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            owner, *found = super_kmers(x["text"].tolist(), window, seed)
            if not len(owner):
                continue
            cut = np.flatnonzero(np.diff(owner)) + 1
            who = owner[np.concatenate(([0], cut))]
            made = {"key": x["key"].to_numpy()[who]}
            for name, kind, column in zip(("start", "n", "mini", "twice"), (np.int32, np.int32, np.int64, np.bool_), found, strict=True):
                made[name] = np.split(column.astype(kind), cut)
            yield pd.DataFrame(made)

    return map_frames(docs.select("key", "text"), run, struct(key="binary", start="array<int>", n="array<int>", mini="array<bigint>", twice="array<boolean>"))


def _packed(found: DataFrame, window: int) -> DataFrame:
    """The flagged super-k-mers of distinct texts as packed strings."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for key, text, c, flagged in zip(x["key"], x["text"], x["c"], x["flagged"], strict=True):
                w = words(text)
                rows += [(key, c, p["start"], p["mini"], " ".join(w[p["start"] : p["start"] + p["n"] + window - 1])) for p in flagged]
            yield pd.DataFrame(rows, columns=["key", "c", "start", "mini", "packed"])

    return map_frames(found.select("key", "text", "c", "flagged"), run, struct(key="binary", c="long", start="int", mini="long", packed="string")).withColumn("sid", F.unhex(F.md5(F.col("packed").cast("binary"))))


def repeated_runs(strings: list[str], weights: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each string the runs of its windows that occur more than once among all of them. Windows are sorted, equal ones meet."""
    laid: list[str] = []
    where: list[tuple[int, int]] = []
    for k, s in enumerate(strings):
        w = s.split(" ")
        for j in range(len(w) - window + 1):
            laid.append(" ".join(w[j : j + window]))
            where.append((k, j))
    marks: list[list[int]] = [[] for _ in strings]
    order = sorted(range(len(laid)), key=laid.__getitem__)
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and laid[order[b]] == laid[order[a]]:
            b += 1
        if b - a > 1 or weights[where[order[a]][0]] > 1:
            for i in order[a:b]:
                k, j = where[i]
                marks[k].append(j)
        a = b
    return [merged(m) for m in marks]


def merged(at: list[int]) -> list[tuple[int, int]]:
    """Sorted numbers as runs from a to b - 1."""
    out: list[tuple[int, int]] = []
    for j in sorted(at):
        if out and out[-1][1] == j:
            out[-1] = (out[-1][0], j + 1)
        else:
            out.append((j, j + 1))
    return out


def _count_buckets(p: DataFrame, window: int) -> DataFrame:
    """Each task reads its buckets one after the other, sorted by minimiser; a bucket that an Arrow batch cuts waits for its rest."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(x: pd.DataFrame) -> pd.DataFrame:
            found = repeated_runs(x["packed"].tolist(), x["c"].tolist(), window)
            kept = [(s, [{"a": a, "b": b} for a, b in r]) for s, r in zip(x["sid"], found, strict=True) if r]
            return pd.DataFrame(kept, columns=["sid", "runs"])

        rest = None
        for x in batches:
            x = x if rest is None else pd.concat([rest, x], ignore_index=True)
            open_ = x["mini"] == x["mini"].iloc[-1]
            rest = x[open_]
            if not open_.all():
                yield done(x[~open_])
        if rest is not None:
            yield done(rest)

    return map_frames(p.select("mini", "sid", "packed", "c").repartition(partitions(p), "mini").sortWithinPartitions("mini"), run, struct(sid="binary", runs="array<struct<a:int,b:int>>"))


def _count_windows(p: DataFrame, window: int) -> DataFrame:
    """The same for buckets of too many strings: every window is dealt out by its own words, and counted with partial aggregation."""
    w = F.split("packed", " ", -1)
    each = p.select("sid", "c", w.alias("w")).select("sid", "c", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - (window - 1)), lambda j: F.array_join(F.slice("w", j, window), " "))).alias("j", "words"))
    again = each.groupBy("words").agg(F.sum("c").alias("total")).where("total > 1").select("words")
    hit = each.join(again, "words", "left_semi").groupBy("sid").agg(F.collect_set("j").alias("js"))
    return hit.select("sid", F.transform("js", lambda j: F.struct(j.alias("a"), (j + 1).alias("b"))).alias("runs"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(key, ranges): for each text with repeated windows, by the md5 of its UTF-8, the word ranges that they cover; stored, one row a
    text. docs: key, text. Only texts with a minimiser that stands elsewhere as well leave their partition."""
    found = stored(_scan(docs, window, seed), "kmers")
    each = found.select("key", F.explode(F.arrays_zip("start", "n", "mini", "twice")).alias("p"))
    again = each.groupBy(F.col("p.mini").alias("mini")).agg(F.sum(F.lit(1) + F.col("p.twice").cast("int")).alias("k")).where("k > 1").select("mini")
    flagged = stored(each.withColumn("mini", F.col("p.mini")).join(again, "mini", "left_semi").groupBy("key").agg(F.collect_set("p").alias("flagged")), "flagged")
    forget(found)
    one = docs.join(flagged.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("c"))
    strings = stored(_packed(one.join(flagged, "key"), window), "strings")
    forget(flagged)
    p = stored(strings.groupBy("mini", "sid").agg(F.first("packed").alias("packed"), F.sum("c").alias("c")), "buckets")
    large = p.groupBy("mini").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("mini")
    runs_of = _count_buckets(p.join(large, "mini", "left_anti"), window).unionByName(_count_windows(p.join(large, "mini", "left_semi"), window))
    marked = stored(runs_of, "runs")
    forget(p)
    hits = strings.select("key", "start", "sid").join(marked, "sid")
    words_of = hits.select("key", F.transform("runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start") + (window - 1)).alias("b"))).alias("r"))
    ranges = stored(words_of.groupBy("key").agg(F.flatten(F.collect_list("r")).alias("ranges")), "ranges")
    forget(strings, marked)
    return ranges


def _outside(w: list[str], found: Iterable | None) -> list[str] | None:
    """The words that no range covers; None if none is covered."""
    if found is None or not len(found):
        return None
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, [r["a"] for r in found], 1)
    np.add.at(edge, [r["b"] for r in found], -1)
    return [w[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """doc_id, text, n_words, n_removed and kept: the words outside all repeated windows, joined by one space."""
    docs = keyed(df, key, text)
    ranges = repeated_ranges(docs.select("key", "text"), window, seed, hot)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for t, found in zip(x["text"], x["ranges"], strict=True):
                w = words(t)
                kept = _outside(w, found)
                rows.append((len(w), 0 if kept is None else len(w) - len(kept), " ".join(w if kept is None else kept)))
            made = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
            made.insert(0, "text", x["text"])
            made.insert(0, "doc_id", x["doc_id"])
            yield made

    joined = docs.join(ranges, "key", "left").select("doc_id", "text", "ranges")
    return map_frames(joined, run, struct(doc_id=kind_of(docs), text="string", n_words="long", n_removed="long", kept="string"))


def cut_repeats(df: DataFrame, text: str = "text", window: int = WINDOW, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """df with its repeated windows cut out of the text. Texts that have none, null ones too, and all other columns stay as they are."""
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.unhex(F.md5(plain.cast("binary")))
    ranges = repeated_ranges(df.select(key.alias("key"), plain.alias("text")), window, seed, hot).toDF(KEY, RANGES)

    def now(many: list[str | None], batch: pa.RecordBatch) -> list[str | None]:
        out = []
        for t, found in zip(many, batch.column(RANGES).to_pylist(), strict=True):
            kept = None if t is None else _outside(words(t), found)
            out.append(t if kept is None else " ".join(kept))
        return out

    joined = df.withColumn(KEY, key).join(ranges, KEY, "left")
    return map_text(joined.select(*[F.col(f"`{c}`") for c in df.columns], RANGES), now, text, (RANGES,))
