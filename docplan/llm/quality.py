"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams: words and pairs of words, and runs of one to three word shapes, a shape being a word's
kinds of characters with its marks and whether it repeats the word before. Each indicator is scaled by its class log-count ratio, and
a linear model with hinge loss is fitted to the scaled vectors by dual coordinate descent. Margins become probabilities by a logistic
model that is fitted on rows apart.

The model comes from at most `rows` labelled documents (a documented bound); every document is scored over its whole text. Null and
empty texts have no features and get the score of the constant alone. Very long texts are scored whole; batches are bounded by bytes,
so memory grows with the longest text alone. Shapes are cut to 12 characters, which is a feature's definition and not a limit on texts. Without labelled rows of both classes, or with an empty table,
every score is the share of good labels, 0.5 without any. Repeated rows get equal scores; extra columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import kind_of, map_frames, struct
from .learning import Words, calibrate, hashed, held, laid, logistic, sample, trained

#: Labelled documents that the model is fitted to at most.
ROWS = 8000
BITS = 18
#: An indicator counts from this many training documents on.
LEAST = 4
FOLDS, HELD_OUT = 3, 1

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_kinds = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "C" if m[0][0].isupper() else "a"), (re.compile(r"[0-9]+"), lambda m: "0"), (re.compile(r"([^\w])\1+"), lambda m: m[1] * 2))


def shape(word: str) -> str:
    for pattern, to in _kinds:
        word = pattern.sub(to, word)
    return word[:12]


def _describe(words: list[str]) -> dict[str, np.ndarray]:
    return {"word": hashed([w.lower() for w in words]), "shape": hashed([shape(w) for w in words])}


_table = Words(_describe)


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    out = np.array([0x2545F4914F6CDD1D], np.uint64)
    for p in parts:
        out = (out ^ np.asarray(p, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out


def indicators(many: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram numbers of each text, end to end, and where each text's begin, with the end."""
    flat, at = laid(many, _words)
    number = _table.numbers(flat)
    owner = np.repeat(np.arange(len(many)), np.diff(at))
    word, form = _table.columns["word"][number], _table.columns["shape"][number]
    same = np.zeros(len(flat), np.uint64)
    if len(flat):
        same[1:] = (number[1:] == number[:-1]) & (owner[1:] == owner[:-1])
    form = _mix(form, same)
    codes, owners = [_mix(1, word), _mix(2, form)], [owner, owner]
    for k in (2, 3):
        if len(flat) < k:
            break
        inside = owner[k - 1 :] == owner[: 1 - k]
        runs = [form[j : len(form) - k + 1 + j] for j in range(k)]
        codes.append(_mix(k + 1, *runs)[inside])
        owners.append(owner[k - 1 :][inside])
        if k == 2:
            codes.append(_mix(9, word[:-1], word[1:])[inside])
            owners.append(owners[-1])
    code = (np.concatenate(codes) >> np.uint64(64 - bits)).astype(np.int64)
    key = np.unique(np.concatenate(owners) << bits | code)
    return key & (1 << bits) - 1, np.searchsorted(key >> bits, np.arange(len(many) + 1))


class Model(NamedTuple):
    weight: np.ndarray  # of each indicator, the log-count ratio included
    ratio: np.ndarray  # the log-count ratios, zero for rare indicators
    slope: float
    constant: float

    def margins(self, many: list[str]) -> np.ndarray:
        codes, at = indicators(many)
        owner = np.repeat(np.arange(len(many)), np.diff(at))
        total = np.bincount(owner, self.weight[codes], len(many))
        norm = np.sqrt(np.bincount(owner, self.ratio[codes] ** 2, len(many)))
        return total / np.maximum(norm, 1e-9)

    def scores(self, many: list[str]) -> np.ndarray:
        return logistic(self.slope * self.margins(many) + self.constant) if self.slope else np.full(len(many), logistic(np.array(self.constant)))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """The w of the smallest |w|^2 / 2 + sum of cost * hinge(y w x): one dual variable at a time, in a new order each epoch."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)).tolist():
            if not square[i]:
                continue
            at, v = rows[i]
            slope = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                largest = max(largest, abs(new - alpha[i]))
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


def fit(many: list[str], y: np.ndarray, cost: float = 1.0, smooth: float = 1.0, bits: int = BITS) -> Model:
    """y: 1 good, 0 bad. Every fifth row, in the given order, is kept for calibration."""
    size = 1 << bits
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, float(np.log(share / (1 - share))))
    apart = np.arange(len(many)) % 5 == 4
    apart &= len(many) >= 50
    found: list[np.ndarray] = []  # the numbers of each text; made by some texts at a time, so that words don't pile up in the driver
    for k in range(0, len(many), 128):
        codes, at = indicators(many[k : k + 128], bits)
        found += np.split(codes.astype(np.int32), at[1:-1])
    good, every = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for i in np.flatnonzero(~apart).tolist():
        every[found[i]] += 1
        if y[i]:
            good[found[i]] += 1
    p, q = good + smooth, every - good + smooth
    ratio = np.where(every >= LEAST, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0).astype(np.float32)
    rows = []
    for i, c in enumerate(found):
        v = ratio[c]
        c, v = c[v != 0], v[v != 0]
        rows.append((c, v / max(np.linalg.norm(v), 1e-9)))
        found[i] = c
    train = np.flatnonzero(~apart)
    share = y[train].mean()
    costs = np.where(y[train] > 0, cost * 0.5 / max(share, 1e-6), cost * 0.5 / max(1 - share, 1e-6))
    w = dual_descent([rows[i] for i in train], np.where(y[train] > 0, 1.0, -1.0), costs, size)
    model = Model((w * ratio).astype(np.float32), ratio.astype(np.float32), 1.0, 0.0)
    rest = np.flatnonzero(apart) if apart.any() and len(set(y[apart].tolist())) == 2 else np.arange(len(many))
    slope, constant = calibrate(np.concatenate([model.margins([many[i] for i in part]) for part in np.split(rest, range(128, len(rest), 128))])[:, None], y[rest])
    return model._replace(slope=float(slope), constant=float(constant))


def score(documents: DataFrame, labels: DataFrame, rows: int = ROWS, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = trained(sample(documents, labels, "quality", FOLDS, HELD_OUT, rows), lambda x: fit(x["text"].tolist(), x["y"].to_numpy(int)))
    t = held(documents, FOLDS, HELD_OUT)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            s = model.scores(x["text"].tolist())
            yield pd.DataFrame({"doc_id": x["doc_id"], "held_out": x["held_out"], "score": s, "predicted": (s >= cut).astype(np.int32)})

    return map_frames(t, run, struct(doc_id=kind_of(t), held_out="boolean", score="double", predicted="int"))
