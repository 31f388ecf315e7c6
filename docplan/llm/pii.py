"""Personal data: patterns, and a skip-chain conditional random field that makes a document's labels agree.

Patterns give the base spans: email addresses, IP addresses, card numbers that pass Luhn's check, international phone numbers. Runs of
digits and strings around an at sign that no pattern took are candidates. A document's candidates and base spans form a graph: links
between neighbours in the text, and skip links between candidates that are the same or similar (equal digits, the same last ten
digits, the same name before the at sign), however far apart. Loopy message passing over it, with the base spans' labels as evidence,
gives each candidate's marginals; those that are sure of a kind become spans as well.

Potentials are trained on at most `rows` documents whose base spans are their labels (a documented bound); every document is searched
whole, and a candidate is a whole run of characters that aren't white space, however long. Links to neighbours reach `NEAR` characters,
which is the chain's definition; skip links reach over the whole text. Null and empty texts have no spans. Very long texts cost memory
by their candidates. Rows may repeat; an empty table gives an empty result; extra columns are ignored by find() and kept as they are by
redact(). Base spans stay as they are; an added span never overlaps another."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_frames, map_text, struct, texts
from .learning import hashed, trained

#: Documents that potentials are trained on at most.
ROWS = 6000
KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
BITS = 14
#: A candidate is a span from this marginal on.
SURE = 0.9
#: Neighbouring candidates within so many characters are linked.
NEAR = 60
ROUNDS = 10

# The patterns of the four kinds. The marks before them only spare starts that an earlier start includes.
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]+")
_white = re.compile(r"\s")
_digits_run = re.compile(r"\+?\(?[0-9](?:[0-9]|[ ().-]{1,2}(?=[0-9]))*")
_local_letters = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


class Span(NamedTuple):
    kind: int  # its place in KINDS
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap, found from their at signs, so that long runs without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local_letters:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    found = [Span(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
            found.append(Span(1, m.start(), m.end()))
    for m in _card.finditer(text):
        if 12 <= m.end() - m.start() <= 2 * 19 and 12 <= len(d := _not_digit.sub("", m[0])) <= 19 and luhn(d):
            found.append(Span(2, m.start(), m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= len(_not_digit.sub("", m[0])) <= 15:
                found.append(Span(3, m.start(), m.end()))
    found.sort(key=lambda s: (s.start, s.kind))
    return found


class Node(NamedTuple):
    start: int
    end: int
    label: int  # 0: open; else one more than the base span's kind
    features: tuple[str, ...]
    keys: tuple[str, ...]


def _describe(text: str, a: int, b: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    s = text[a:b]
    digits = _not_digit.sub("", s)
    groups = "-".join(str(min(len(g), 20)) for g in re.split(r"[^0-9]+", s) if g)[:40]
    marks = "".join(sorted({c for c in s if not c.isalnum()}))[:12]
    valid = f"{12 <= len(digits) <= 19 and luhn(digits)}{len(g := s.split('.')) == 4 and all(p.isdigit() and int(p[:4]) <= 255 for p in g)}"
    before, behind = text[max(0, a - 24) : a], text[b : b + 24]
    left, right = before.split()[-1:] or [""], behind.split()[:1] or [""]
    inside = (before[-1:].isalnum() or before[-1:] in "_") and before != "", (behind[:1].isalnum() or behind[:1] == "_") and behind != ""
    features = (f"n{min(len(digits), 24)}", f"g{groups}", f"m{marks}", f"h{s[:1] if not s[:1].isalnum() else '0' if s[:1].isdigit() else 'a'}", f"l{left[0].lower()[-8:]}", f"r{right[0].lower()[:8]}", f"i{inside}", f"@{'@' in s}", f"v{valid}")
    keys = []
    if "@" in s:
        keys.append("@" + s.partition("@")[0].lower())
    elif len(digits) >= 7:
        keys.append("d" + digits)
        if len(digits) > 10:
            keys.append("t" + digits[-10:])
        if len(digits) == 10:
            keys.append("t" + digits)
    return features, tuple(keys)


def nodes(text: str, spans: list[Span]) -> list[Node]:
    """Base spans and what else might be personal data, in text order. Of overlapping base spans the first is the graph's."""
    taken: list[tuple[int, int, int]] = []
    for s in spans:
        if not taken or s.start >= taken[-1][1]:
            taken.append((s.start, s.end, s.kind + 1))
    free: list[tuple[int, int, int]] = []
    ends = [(0, 0, 0), *taken, (len(text), len(text), 0)]
    for (_, a, _), (b, _, _) in zip(ends[:-1], ends[1:], strict=True):
        runs = [(m.start(), m.end(), 0) for m in _digits_run.finditer(text, a, b) if sum(c.isdigit() for c in m[0]) >= 7]
        free += runs
        at = text.find("@", a, b)
        while at >= 0:
            x, y = at, at + 1
            while x > a and not text[x - 1].isspace():
                x -= 1
            m = _white.search(text, y, b)
            y = m.start() if m else b
            k = bisect_left(runs, (y,))  # the last run of digits that begins before the candidate ends
            if y - x > 1 and not (k and runs[k - 1][1] > x):
                free.append((x, y, 0))
            at = text.find("@", y, b)
    return [Node(a, b, k, *_describe(text, a, b)) for a, b, k in sorted([*taken, *free])]


def links(many: list[list[Node]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours and of similar nodes, numbered over all documents. A node has a skip link to the last and to the first one
    like it, so there are no more links than nodes and keys."""
    chain, skip, base = [], [], 0
    for doc in many:
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for i, node in enumerate(doc):
            if i and node.start - doc[i - 1].end <= NEAR:
                chain.append((base + i - 1, base + i))
            for k in node.keys:
                for j in {first.setdefault(k, i), last.get(k, i)} - {i}:
                    skip.append((base + j, base + i))
                last[k] = i
        base += len(doc)
    return np.array(chain, np.int64).reshape(-1, 2), np.array(sorted(set(skip)), np.int64).reshape(-1, 2)


class Field(NamedTuple):
    weights: np.ndarray  # 2 ** BITS x LABELS
    chain: np.ndarray  # LABELS x LABELS, logs
    skip: np.ndarray

    def marginals(self, many: list[list[Node]]) -> np.ndarray:
        flat = [x for doc in many for x in doc]
        if not flat:
            return np.empty((0, LABELS))
        unary = self.weights[_numbers(flat)].sum(1)
        told = np.array([x.label for x in flat])
        unary[told > 0] = -30.0  # evidence
        unary[told > 0, told[told > 0]] = 0.0
        a, b = links(many)
        return belief(unary, [(a, self.chain), (b, self.skip)])


def belief(unary: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Marginals by loopy message passing with logs, all links at once. Trees are exact after as many rounds as they are deep."""
    source = np.concatenate([np.concatenate([e[:, 0], e[:, 1]]) for e, _ in kinds])
    target = np.concatenate([np.concatenate([e[:, 1], e[:, 0]]) for e, _ in kinds])
    back = np.concatenate([o + np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))]) for (e, _), o in zip(kinds, np.cumsum([0, *(2 * len(e) for e, _ in kinds)]), strict=False)]).astype(np.int64)
    pair = np.concatenate([np.concatenate([np.repeat(p[None], len(e), 0), np.repeat(p.T[None], len(e), 0)]) for e, p in kinds])
    m = np.zeros((len(source), unary.shape[1]))

    def total() -> np.ndarray:
        out = unary.copy()
        np.add.at(out, target, m)
        return out

    for _ in range(rounds if len(source) else 0):
        rest = total()[source] - m[back]
        new = np.logaddexp.reduce(rest[:, :, None] + pair, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        new = 0.5 * m + 0.5 * new
        if np.abs(new - m).max() < 1e-4:
            m = new
            break
        m = new
    b = total()
    return np.exp(b - np.logaddexp.reduce(b, axis=1, keepdims=True))


def _numbers(flat: list[Node]) -> np.ndarray:
    h = hashed([f for x in flat for f in x.features]) >> np.uint64(64 - BITS)
    return h.astype(np.int64).reshape(len(flat), -1)


def fit(many: list[str], steps: int = 150, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Piecewise training: unary weights by the likelihood of each node's label, link potentials by how much oftener two labels are
    linked than apart. A candidate outside all base spans is labelled as none."""
    docs = [nodes(t, base_spans(t)) for t in many]
    flat = [x for d in docs for x in d]
    w = np.zeros((1 << BITS, LABELS))
    if not flat:
        w[:, 0] = 1.0
        return Field(w, np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    f, y = _numbers(flat), np.array([x.label for x in flat])
    used, place = np.unique(f, return_inverse=True)
    place = place.reshape(f.shape)
    v, g = np.zeros((len(used), LABELS)), np.full((len(used), LABELS), 1e-8)
    truth = np.eye(LABELS)[y]
    for _ in range(steps):
        z = v[place].sum(1)
        p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        grad = np.stack([np.bincount(place.ravel(), np.repeat((p - truth)[:, k], f.shape[1]), len(used)) for k in range(LABELS)], 1) / len(flat) + ridge / len(flat) * v
        g += grad**2
        v -= rate * grad / np.sqrt(g)
    w[used] = v
    share = (np.bincount(y, minlength=LABELS) + 0.5) / (len(y) + 0.5 * LABELS)

    def potential(pairs: np.ndarray, smooth: float) -> np.ndarray:
        apart = np.outer(share, share)
        count = np.zeros((LABELS, LABELS))
        np.add.at(count, (y[pairs[:, 0]], y[pairs[:, 1]]), 1)
        count = (count + count.T) / 2 + smooth * (0.5 * apart + 0.5 * np.diag(share))
        return np.clip(np.log(count / count.sum() / apart), -4, 4)

    a, b = links(docs)
    return Field(w, np.clip(potential(a, 20.0), -1, 1), potential(b, 5.0))


def train(documents: DataFrame, rows: int = ROWS) -> Field:
    """From the documents that are first by a hash of their identifier."""
    some = documents.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    found = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).join(F.broadcast(some), "doc_id", "left_semi")
    return trained(found, lambda x: fit(x["text"].tolist()))


def all_spans(field: Field, many: list[str], sure: float = SURE) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) for t in many]
    graph = [nodes(t, s) for t, s in zip(many, base, strict=True)]
    p = field.marginals(graph)
    out, at = [], 0
    for spans, doc in zip(base, graph, strict=True):
        mine = p[at : at + len(doc)]
        at += len(doc)
        best = mine[:, 1:].argmax(1) if len(doc) else []
        out.append((spans, [Span(int(k), x.start, x.end) for x, k, q in zip(doc, best, mine, strict=True) if not x.label and q[k + 1] >= sure]))
    return out


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, s.kind)))


def find(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text", sure: float = SURE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base (base spans, joined), and spans (all spans, joined)."""
    t = texts(df, key, text)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for base, more in all_spans(field, x["text"].tolist(), sure):
                count = [0] * len(KINDS)
                for s in base:
                    count[s.kind] += 1
                rows.append((*count, joined(base), joined([*base, *more])))
            found = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base", "spans"])
            found.insert(0, "doc_id", x["doc_id"])
            yield found

    return map_frames(t, run, struct(doc_id=kind_of(t), **{f"n_{k}": "long" for k in KINDS}, base="string", spans="string"))


def cover(text: str, spans: Iterable[Span]) -> str:
    """The text with each span, or what overlapping spans cover, as the first one's kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, s.kind)):
        if s.start >= at:
            out += [text[at : s.start], f"[{KINDS[s.kind].upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, field: Field, text: str = "text", sure: float = SURE) -> DataFrame:
    """df with every span of its text covered. Null texts stay null, other columns as they are."""

    def now(many: list[str | None], batch: object) -> list[str | None]:
        plain = [t or "" for t in many]
        return [None if t is None else cover(t, [*a, *b]) for t, (a, b) in zip(many, all_spans(field, plain, sure), strict=True)]

    return map_text(df, now, text)
