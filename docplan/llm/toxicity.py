"""Toxicity: a linear-chain conditional random field tags toxic spans, and its marginals make a document's score.

Labels are of documents, so tokens are labelled from afar: a word is a toxic token where it stands in a toxic document, if nearly all
labelled documents that have it are toxic and it stands there between many different neighbours (copies of one document don't count
twice). On these labelled tokens a chain of two labels is trained by gradient steps on the exact likelihood, with features of the
word, its beginning, end and shape, and its neighbours. Forward and backward messages give each token's marginal; adjacent tokens over
a threshold are a span; the expected number of toxic tokens and the largest marginal, calibrated on documents, give the score.

The model comes from at most `rows` labelled documents (a documented bound); every document is tagged over its whole text. Null and
empty texts have no tokens and get the score of none. Very long texts are tagged whole: batches are bounded by bytes, so memory grows
with the longest text alone, by some hundred bytes a token. Without labelled rows of both classes, or where no word tells them apart,
nothing is learnt: every score is the share of toxic labels, 0 without any, and keep_clean keeps every row. Repeated rows get equal
scores; an empty table gives an empty result; extra columns are ignored, or kept as they are by keep_clean."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kind_of, map_batches, map_frames, struct
from .learning import Words, calibrate, hashed, held, laid, logistic, plain_words, sample, trained

#: Labelled documents that the model is fitted to at most.
ROWS = 5000
BITS = 18
FOLDS, HELD_OUT = 4, 2
CUT = 0.3
#: A token is of a span from this marginal on.
SPAN = 0.5
#: A toxic word: documents that have it, share of them that is toxic, different pairs of neighbours in toxic documents.
DOCUMENTS, SHARE, NEIGHBOURS = 4, 0.8, 6


def _shape(w: str) -> str:
    return f"{min(len(w), 12)}{'d' if any(c.isdigit() for c in w) else 'a' if w.isascii() else 'u'}"


def _describe(words: list[str]) -> dict[str, np.ndarray]:
    low = [w.lower() for w in words]
    top = np.uint64(64 - BITS)
    return {"word": (hashed(low) >> top).astype(np.int64), "head": (hashed(["^" + w[:3] for w in low]) >> top).astype(np.int64), "tail": (hashed([w[-3:] + "$" for w in low]) >> top).astype(np.int64), "shape": (hashed([_shape(w) for w in low]) >> top).astype(np.int64)}


_table = Words(_describe)
#: Each kind of feature has weights of its own.
KINDS = ("word", "head", "tail", "shape", "before", "behind")


def chain(u: np.ndarray, at: np.ndarray, trans: np.ndarray, width: int = 256) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of label 1, expected label pairs (2 x 2, summed), and the sum of the log partition functions of chains that lie end to
    end. u: log-odds of label 1 at each token; trans: log weights of label pairs; at: where chains begin, with the end.

    Exact, and parallel: the tokens are cut into columns of `width`, each column's 2 x 2 product is made for all columns at once, the
    columns' products are chained, and then each column is run again from what comes into it. A chain's first step forgets what was."""
    n = len(u)
    if not n:
        return np.empty(0), np.zeros((2, 2)), 0.0
    first = np.zeros(n, bool)
    first[at[:-1][np.diff(at) > 0]] = True
    e = np.exp(np.clip(u, -30, 30))
    t = np.exp(trans)
    columns = -(-n // width)
    pad = columns * width - n
    e_, f_ = (np.concatenate([x, fill]).reshape(columns, width).T for x, fill in ((e, np.ones(pad)), (first, np.ones(pad, bool))))

    def sweep(e_: np.ndarray, cut: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normalised messages (for label 0 and 1) behind each step, and each step's log scale. cut: the step starts anew."""
        p = np.broadcast_to(np.eye(2), (columns, 2, 2)).copy()
        for k in range(width):  # products of whole columns
            p = np.where(cut[k][:, None, None], p.sum(2, keepdims=True) * 0.5, p @ t)
            p[:, :, 1] *= e_[k][:, None]
            p /= p.sum((1, 2), keepdims=True)
        into = np.empty((columns, 2))
        v = np.array([0.5, 0.5])
        for c in range(columns):
            into[c] = v
            v = v @ p[c]
            v = v / v.sum()
        m, scale = np.empty((width, columns, 2)), np.empty((width, columns))
        v = into
        for k in range(width):
            v = np.where(cut[k][:, None], 1.0, v @ t)
            v = v * np.stack([np.ones(columns), e_[k]], 1)
            s = v.sum(1)
            v = v / s[:, None]
            m[k], scale[k] = v, np.log(s)
        return m, scale

    alpha, scale = sweep(e_, f_, t)
    # backward: the same over the reversed tokens; a message that includes its token's own weight
    last = np.zeros(n, bool)
    last[at[1:][np.diff(at) > 0] - 1] = True
    r_e, r_f = (np.concatenate([x[::-1], fill]).reshape(columns, width).T for x, fill in ((e, np.ones(pad)), (last, np.ones(pad, bool))))
    beta, _ = sweep(r_e, r_f, t.T)
    a = alpha.transpose(1, 0, 2).reshape(-1, 2)[:n]
    b = beta.transpose(1, 0, 2).reshape(-1, 2)[:n][::-1]
    both = a * b / np.stack([np.ones(n), e], 1)
    p = both[:, 1] / both.sum(1)
    link = np.flatnonzero(~first[1:])
    pairs = a[link][:, :, None] * t[None] * b[link + 1][:, None, :]
    pairs /= pairs.sum((1, 2), keepdims=True)
    return p, pairs.sum(0), float(scale.T.reshape(-1)[:n].sum())


def rows_of(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (tokens x kinds) and where each text's tokens begin."""
    flat, at = laid(many, plain_words)
    number = _table.numbers(flat)
    c = _table.columns
    word = c["word"][number]
    edge = np.int64(0)
    before, behind = np.concatenate(([edge], word[:-1])), np.concatenate((word[1:], [edge]))
    some = np.diff(at) > 0
    if len(word):
        before[at[:-1][some]] = edge
        behind[at[1:][some] - 1] = edge
    else:
        before = behind = word
    return np.stack([word, c["head"][number], c["tail"][number], c["shape"][number], before, behind], 1), at


class Tagger(NamedTuple):
    weights: np.ndarray  # kinds x 2 ** BITS
    bias: float
    trans: np.ndarray
    document: np.ndarray  # of expected tokens, of the largest marginal, constant
    learnt: bool = True

    def marginals(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        f, at = rows_of(many)
        u = self.bias + sum(self.weights[k][f[:, k]].astype(np.float64) for k in range(len(KINDS)))
        return chain(u, at, self.trans)[0], at

    def scores(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        return logistic(summary(p, at) @ self.document[:-1] + self.document[-1])


def summary(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each document log(1 + expected toxic tokens) and the largest marginal; zeros without tokens. What is under one part in a
    thousand is no token's doubt but many clean ones', and doesn't add up."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    expected = np.bincount(owner, np.where(p > 1e-3, p, 0), n)
    most = np.zeros(n)
    np.maximum.at(most, owner, p)
    return np.column_stack([np.log1p(expected), most])


def toxic_words(many: list[str], y: np.ndarray) -> set[str]:
    """Words that tell toxic documents, by documents that have them and by different neighbours."""
    toxic: dict[str, int] = {}
    every: dict[str, int] = {}
    near: dict[str, set] = {}
    for text, label in zip(many, y.tolist(), strict=True):
        w = [x.lower() for x in plain_words(text)]
        for x in set(w):
            every[x] = every.get(x, 0) + 1
            if label:
                toxic[x] = toxic.get(x, 0) + 1
        if label:
            for a, b, c in zip(["", *w[:-1]], w, [*w[1:], ""], strict=True):
                pairs = near.setdefault(b, set())
                if len(pairs) < NEIGHBOURS:  # more aren't asked for
                    pairs.add((a, c))
    return {w for w, k in toxic.items() if k >= DOCUMENTS and k >= SHARE * every[w] and len(near[w]) >= NEIGHBOURS}


def fit(many: list[str], y: np.ndarray, steps: int = 40, rate: float = 0.5, ridge: float = 1e-6) -> Tagger:
    size = 1 << BITS
    share = np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9)
    none = Tagger(np.zeros((len(KINDS), size), np.float32), -5.0, np.zeros((2, 2)), np.array([0.0, 0.0, float(np.log(share / (1 - share)))]), False)
    words = toxic_words(many, y)
    if len(set(y.tolist())) < 2 or not words:
        return none
    # tokens are learnt from all toxic documents and as many clean ones again, by line; documents are calibrated on all
    lines, labels = [], []
    clean = int(y.sum())
    for text, label in zip(many, y.tolist(), strict=True):
        clean -= not label
        if not label and clean < 0:
            continue
        for line in re.split(r"[\n.!?]", text):
            w = plain_words(line)
            if w:
                lines.append(line)
                labels += [bool(label) and x.lower() in words for x in w]
    f, at = rows_of(lines)
    target = np.array(labels, float)
    f += np.arange(len(KINDS)) * size
    used = np.unique(f)
    f = np.searchsorted(used, f).astype(np.int32)
    first = np.zeros(len(target), bool)
    first[at[:-1]] = True
    link = np.flatnonzero(~first[1:])
    seen = np.zeros((2, 2))
    np.add.at(seen, (target[link].astype(int), target[link + 1].astype(int)), 1)
    w, bias, trans = np.zeros(len(used)), -4.0, np.zeros((2, 2))
    g_w, g_b, g_t = np.full(len(used), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    scale = 1 / max(1.0, target.sum())
    for _ in range(steps):  # steps scaled by the gradients so far
        p, pairs, _ = chain(bias + w[f].sum(1), at, trans)
        d = (p - target) * scale
        grad = np.bincount(f.ravel(), np.repeat(d, len(KINDS)), len(used)) + ridge * w
        g_w += grad**2
        w -= rate * grad / np.sqrt(g_w)
        g_b += d.sum() ** 2
        bias -= rate * d.sum() / np.sqrt(g_b)
        d_t = (pairs - seen) * scale
        g_t += d_t**2
        trans -= rate * d_t / np.sqrt(g_t)
    weights = np.zeros(len(KINDS) * size, np.float32)
    weights[used] = w
    tagger = none._replace(weights=weights.reshape(len(KINDS), size), bias=float(bias), trans=trans, learnt=True)
    parts = [summary(*tagger.marginals(many[k : k + 256])) for k in range(0, len(many), 256)]
    return tagger._replace(document=calibrate(np.concatenate(parts), y.astype(float)))


def train(documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> Tagger:
    return trained(sample(documents, labels, "toxic", FOLDS, HELD_OUT, rows), lambda x: fit(x["text"].tolist(), x["y"].to_numpy(int)))


def score(documents: DataFrame, tagger: Tagger, cut: float = CUT, span: float = SPAN) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start, end, marginal; code points) for every document."""
    t = held(documents, FOLDS, HELD_OUT)
    find = re.compile(r"[^\W_]+")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            many = x["text"].tolist()
            p, at = tagger.marginals(many)
            s = tagger.scores(p, at)
            spans: list[list[dict]] = [[] for _ in many]
            hits = np.flatnonzero(p >= span)
            for i in np.unique(np.searchsorted(at, hits, "right") - 1).tolist():
                here = p[at[i] : at[i + 1]]
                was = -2
                for k, m in enumerate(find.finditer(many[i])):
                    if here[k] >= span:
                        if was == k - 1:
                            spans[i][-1]["end"] = m.end()
                            spans[i][-1]["marginal"] = max(spans[i][-1]["marginal"], float(here[k]))
                        else:
                            spans[i].append({"start": m.start(), "end": m.end(), "marginal": float(here[k])})
                        was = k
            yield pd.DataFrame({"doc_id": x["doc_id"], "held_out": x["held_out"], "score": s, "predicted": (s >= cut).astype(np.int32), "spans": spans})

    return map_frames(t, run, struct(doc_id=kind_of(t), held_out="boolean", score="double", predicted="int", spans="array<struct<start:int,end:int,marginal:double>>"))


def keep_clean(df: DataFrame, tagger: Tagger, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of df whose text scores under the cut, with all their columns as they are; all rows where nothing was learnt."""
    if not tagger.learnt:
        return df

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = tagger.scores(*tagger.marginals([t or "" for t in b.column(text).to_pylist()]))
            yield b.filter(pa.array(s < cut))

    return map_batches(df, run, df.schema)
