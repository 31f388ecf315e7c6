"""BPE encoding and decoding with a pair occurrence index.

The words of a partition's texts are laid end to end as one array of symbols. An index maps each rank to all positions where its pair
starts. Active ranks are applied in ascending order; applying one merges all its positions at once and updates only the lists of the
pairs at its borders. In a vocabulary where no pair ranks before a merge that makes one of its parts (`ordered` checks it when a
vocabulary is loaded), that gives each word what merging its own pairs one by one gives.

Null and empty texts have no tokens; their digests are those of the empty string. A word of any length is encoded whole. Repeated rows
give repeated results, an empty table an empty result; columns other than the key and the text are ignored."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import kind_of, map_frames, struct, texts

#: Bytes of runs of letters whose encoding a Python worker keeps; beyond that it starts anew. A bound on memory, without effect on results.
RUNS_KEPT = 160 << 20
#: Characters of text that are gathered before their new words are encoded together.
CHUNK = 8_000_000

# The pre-tokenizer's pattern, and what it is for texts of ASCII and Latin letters only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = "À-ÖØ-öø-ɏ"
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_any = regex.compile(PATTERN.replace("\\s", SPACE))
_latin = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^{SPACE}a-zA-Z{LATIN}0-9]+")
_space, _separators = re.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]")  # str.split() takes these four for white space as well
_beyond = re.compile(rf"[^\x00-\x7f{LATIN}]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary of a tokenizers file with byte letters, a word end and lower case."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.words = {i: w for w, i in self.ids.items()} | {i: w for w, i in self.special.items()}
        self.decimals = {i: str(i) for i in self.words}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in pairs], np.int64)
        right = np.array([self.ids[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        codes = left << 32 | right
        self.rank_of = np.argsort(codes, kind="stable")
        self.codes = codes[self.rank_of]
        letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in letters], np.int64)
        self.last = np.array([self.ids[c + self.end] for c in letters], np.int64)
        born = dict(zip(self.made.tolist(), range(len(pairs)), strict=True))
        self.ordered = all(born.get(a, -1) < i and born.get(b, -1) < i for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)))
        if not self.ordered:
            raise ValueError("a pair of this vocabulary ranks before a merge that makes one of its parts")
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the vocabulary doesn't merge it."""
        code = a << 32 | b
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.rank_of[at], -1)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(v: Vocabulary, words: list[str]) -> list[list[int]]:
    """The token ids of each word."""
    if not words:
        return []
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(x) for x in raw], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))  # a gap of -1 behind each word
    n = int(sizes.sum() + len(sizes))
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    sym = v.inner[data]
    ends = starts + sizes
    sym[ends] = -1
    sym[ends[sizes > 0] - 1] = v.last[data[ends[sizes > 0] - 1]]
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(ranks: np.ndarray, at: np.ndarray) -> None:
        keep = ranks >= 0
        ranks, at = ranks[keep], at[keep]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        for r, part in zip(ranks[np.concatenate(([0], cut))].tolist(), np.split(at, cut), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    enter(v.ranks(sym[:-1], sym[1:]), np.arange(n - 1))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b, c = int(v.left[r]), int(v.right[r]), int(v.made[r])
        at = at[sym[at] == a]
        at = at[sym[following[at]] == b]
        if a == b and len(at) > 1:  # of a run of overlapping pairs every other one, from the left
            at = np.sort(at)
            first = np.concatenate(([True], following[at[:-1]] != at[1:]))
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
        if not len(at):
            continue
        gone = following[at]
        behind = following[gone]
        sym[at] = c
        sym[gone] = -2
        following[at] = behind
        before[behind] = at  # there is a gap behind each word, so behind < n
        prior = before[at]
        near = prior[prior >= 0]
        enter(v.ranks(sym[near], np.full(len(near), c)) if len(near) else np.empty(0, np.int64), near)
        enter(v.ranks(np.full(len(at), c), sym[behind]), at)
    left = sym != -2
    sym = sym[left]
    cuts = np.flatnonzero(sym == -1)
    flat = sym.tolist()
    out, start = [], 0
    for stop in cuts.tolist():
        out.append(flat[start:stop])
        start = stop + 1
    return out


def normal(text: str) -> str:
    """NFC and lower case letter by letter. White space stays as it is: the pattern drops it, one blank or many."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def pieces(v: Vocabulary, text: str) -> list[str]:
    """The words that are encoded one by one; a special token stays whole and is told by its text."""
    found: list[str] = []
    if v.split_special is not None and any(s in text for s in v.special):
        parts = v.split_special.split(text)
    else:
        parts = [text]
    for part in parts:
        if part in v.special:
            found.append("\0" + part)  # no word starts with this: NUL words have "\0\0" before them, see below
        elif part:
            part = normal(part)
            words = (_any if _beyond.search(part) else _latin).findall(part)
            found += ["\0\0" + w if w[0] == "\0" else w for w in words] if "\0" in part else words
    return found


def all_pieces(v: Vocabulary, runs: list[str]) -> list[list[str]]:
    """pieces() of many runs without white space, normalised together where no special token or NUL is among them."""
    whole = "\n".join(runs)
    if "\0" in whole or any(x in whole for x in v.special):
        return [pieces(v, r) for r in runs]
    whole = normal(whole)
    if _beyond.search(whole):
        return [[r] if r.isascii() and r.isalpha() else (_any if _beyond.search(r) else _latin).findall(r) for r in whole.split("\n")]
    return [[r] if r.isascii() and r.isalpha() else _latin.findall(r) for r in whole.split("\n")]


def runs_of(text: str) -> list[str]:
    """What stands between white space. Pieces never cross it, and normalisation doesn't either, so equal runs have equal ids."""
    return _space.split(text) if _separators.search(text) else text.split()


class Encoder:
    """Encodes many texts, and keeps what it knows about runs of letters without white space in between."""

    def __init__(self, path: str, kept: int = RUNS_KEPT) -> None:
        self.v, self.kept, self.size = vocabulary(path), kept, 0
        self.listed: dict[str, str] = {}
        self.spoken: dict[str, str] = {}
        self.coded: dict[str, bytes] = {}

    def _new(self, known: dict, split: list[list[str]]) -> Iterator[tuple[str, list[int]]]:
        """The runs that aren't known, with their ids; all runs where what is known has grown too large and is dropped."""
        new = set().union(*split).difference(known)
        if known and self.size + sum(map(len, new)) + 300 * len(new) > self.kept:
            self.listed, self.spoken, self.coded, self.size = {}, {}, {}, 0
            new = set().union(*split)
        new.discard("")
        self.size += sum(map(len, new)) + 300 * len(new)
        if not new:
            return
        runs = list(new)
        found = all_pieces(self.v, runs)
        words = list({w: None for p in found for w in p})
        plain = [w[2:] if w[:2] == "\0\0" else w for w in words if not (w[0] == "\0" and w[1:2] != "\0")]
        made = iter(encode_words(self.v, plain))
        ids = {w: [self.v.special[w[1:]]] if w[0] == "\0" and w[1:2] != "\0" else next(made) for w in words}
        for r, p in zip(runs, found, strict=True):
            yield r, ids[p[0]] if len(p) == 1 else [i for w in p for i in ids[w]]

    def encode(self, many: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text its number of tokens, its ids in decimals and its decoded text. The ids' text is what decoding starts from."""
        split = [runs_of(t) for t in many]
        for r, ids in self._new(self.listed, split):
            self.listed[r], self.spoken[r] = " ".join([self.v.decimals[i] for i in ids]), " ".join([self.v.words[i] for i in ids])
        listed, spoken = self.listed.__getitem__, self.spoken.__getitem__
        split.reverse()
        while split:
            w = [x for x in split.pop() if x]
            ids = " ".join(map(listed, w))
            yield (ids.count(" ") + 1 if w else 0), ids, " ".join(map(spoken, w))

    def arrays(self, many: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        split = [runs_of(t) for t in many]
        for r, ids in self._new(self.coded, split):
            self.coded[r] = np.array(ids, "<i4").tobytes()
        self.coded[""] = b""
        coded = self.coded.__getitem__
        for w in split:
            yield np.frombuffer(b"".join(map(coded, w)), "<i4")

    def ids(self, many: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.arrays(many)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker: what it knows about words serves all its tasks."""
    return Encoder(path)


def decode(path: str, ids: Iterable[int]) -> str:
    """The tokens' texts joined by a space: the vocabulary names no decoder."""
    words = vocabulary(path).words
    return " ".join(words[i] for i in ids if i in words)


def chunks(batches: Iterable[pd.DataFrame], chars: int = CHUNK) -> Iterator[pd.DataFrame]:
    """Batches gathered up to about so many characters of text."""
    held: list[pd.DataFrame] = []
    size = 0
    for x in batches:
        held.append(x)
        size += int(x["text"].str.len().sum())
        if size >= chars:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def tokenize(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids, the token ids of each whole text."""
    t = texts(df, key, text)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for x in chunks(batches):
            yield pd.DataFrame({"doc_id": x["doc_id"], "ids": list(coder.arrays(x["text"].tolist()))})

    return map_frames(t, run, struct(doc_id=kind_of(t), ids="array<int>"))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text."""
    t = texts(df, key, text)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for x in chunks(batches):
            rows = []
            for n, ids, said in coder.encode(x["text"].tolist()):
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()))
            found = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            found.insert(0, "doc_id", x["doc_id"])
            yield found

    return map_frames(t, run, struct(doc_id=kind_of(t), n_tokens="long", ids_sha256="string", decoded_sha256="string"))
