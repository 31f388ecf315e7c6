"""What the classifiers share: a bounded sample of labelled rows, word tables and calibration."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_frames, struct, texts

#: Bytes of words that a Python worker keeps what it knows of; a bound on memory, without effect on results.
WORDS_KEPT = 24 << 20


def sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """doc_id, text and y of at most `rows` labelled documents outside the held-out fold, those first by a hash of their identifier. Only their
    identifiers, a bounded number, are broadcast; rows without identifier, label or text teach nothing."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).where(fold(F.col("doc_id"), modulus) != held_out)
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return found.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def trained(rows: DataFrame, fit: Callable[[pd.DataFrame], Any]) -> Any:
    """What fit makes of a bounded sample, sorted by doc_id. It runs in one task, so that the driver holds the model only."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = list(batches)
        if many:
            yield pd.DataFrame({"model": [zlib.compress(pickle.dumps(fit(pd.concat(many, ignore_index=True).sort_values("doc_id", ignore_index=True))), 1)]})

    found = map_frames(rows.repartition(1), run, struct(model="binary")).first()
    return pickle.loads(zlib.decompress(found["model"])) if found else fit(pd.DataFrame({c: [] for c in rows.columns}))


class Words(dict):
    """Numbers of words in order of appearance, and columns that describe each word once."""

    def __init__(self, describe: Callable[[list[str]], dict[str, np.ndarray]], kept: int = WORDS_KEPT) -> None:
        super().__init__()
        self.describe, self.kept, self.new, self.columns, self.size = describe, kept, [], {}, 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def numbers(self, flat: list[str]) -> np.ndarray:
        if self.size > self.kept:
            self.clear()
            self.new, self.columns, self.size = [], {}, 0
        out = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        if self.new or not self.columns:
            more = self.describe(self.new)
            self.columns = {k: np.concatenate([self.columns[k], v]) if k in self.columns else v for k, v in more.items()}
            self.size += sum(map(len, self.new)) + 200 * len(self.new)
            self.new = []
        return out


def hashed(strings: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(strings, dtype=object), categorize=False) if strings else np.empty(0, np.uint64)


def laid(many: list[str], find: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray]:
    """The words of all texts end to end, and where each text's begin, with the end."""
    split = [find(t) for t in many]
    at = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(x) for x in split], out=at[1:])
    return [w for x in split for w in x], at


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model with a constant last, by Newton steps. Targets are drawn in a little, as Platt has it."""
    pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = logistic(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - t) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held(df: DataFrame, modulus: int, rest: int) -> DataFrame:
    """texts() with held_out: the remainder of the identifier's crc32; false for null identifiers."""
    return texts(df).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), modulus) == rest, F.lit(False)))


plain_words = re.compile(r"[^\W_]+").findall
