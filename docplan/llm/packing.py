"""Variable-capacity best-fit packing of documents into training sequences.

Texts are encoded by a byte-level vocabulary, which loses nothing of them, or by the pair occurrence index of `bpe` where the
vocabulary is one of words; each document ends with an end mark. Several sequence lengths are permitted
and each has a cost. Pieces go, longest first, into the open bin that they fill best; where none has room, the bin is opened whose size
costs least for the tokens that it can be expected to hold, given what is still to come; at the end each bin is cut down to the smallest
permitted size that holds its contents. A sequence has its token ids and its documents' boundaries.

Documents are dealt out over shards of about `shard` bytes of text and packed within them; what a shard wastes at its end doesn't grow
with it. Documents longer than the largest size are cut into full pieces and a rest, so very long texts are packed whole. Null and empty
texts have one token, the end mark, so every row is packed. Rows may repeat; each is packed. Ties go by identifier and piece; among bins
with the same room the one that got it last is taken. An empty table gives an empty result; other columns are ignored. Which shard a
piece goes to depends on its identifier, tokens and input partition, so a third of all rows may be equal."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import kind_of, map_frames, struct, texts

SIZES = (512, 1024, 2048, 4096, 8192)
#: Bytes of text of a shard; a task holds one shard's tokens at a time.
SHARD = 16_000_000
#: The token that ends a document, in vocabularies that name it; in others the first free number.
END = "<|endoftext|>"
# Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens at which attention costs as much as everything else, and what a sequence costs by itself, in tokens.
ATTENTION, EACH = 16_384, 32
#: Tokens of the sequences that a task hands over together.
TOGETHER = 1 << 20


def cost(size: int) -> float:
    return size * (1 + size / ATTENTION) + EACH


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's size. Lengths are 1 to the largest size."""
    sizes = sorted(sizes)
    n = np.asarray(lengths, np.int64)
    order = np.argsort(-n, kind="stable")
    bins, offsets = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    used: list[int] = []
    open_: dict[int, list[int]] = {}  # bins by the room that they have
    rooms: list[int] = []
    ascending = n[order][::-1]
    total = np.concatenate(([0], np.cumsum(ascending)))  # tokens of the k shortest
    for k, i in enumerate(order.tolist()):
        size = int(n[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
        else:
            b, least = len(used), float("inf")
            left = len(n) - k - 1  # what is still to come is the `left` shortest
            room = 0
            for s in sizes:
                if s < size:
                    continue
                fits = min(left, int(np.searchsorted(ascending, s - size, "right")))
                filled = size + min(s - size, int(total[fits]))
                need = next(z for z in sizes if z >= filled)  # a bin that won't fill is cut down
                if cost(need) / filled < least - 1e-12:
                    least, room = cost(need) / filled, s
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        room -= size
        if room:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append(b)
    return bins, offsets, np.array([next(z for z in sizes if z >= u) for u in used], np.int64)


class Coder:
    """Token ids of texts. path: a file of ranks (.tiktoken), or of a vocabulary of words (.json)."""

    def __init__(self, path: str, end: str = END) -> None:
        if path.endswith(".json"):
            self.mark, self.arrays = bpe.vocabulary(path).special[end], bpe.encoder(path).arrays
            most = max(bpe.vocabulary(path).words)
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.mark = most = max(ranks.values()) + 1
            self.arrays = lambda many: (coder.encode_to_numpy(t, disallowed_special=()) for t in many)
        self.wide = "<u2" if most < 1 << 16 else "<i4"


@lru_cache(2)
def coder(path: str, end: str = END) -> Coder:
    """One for each Python worker."""
    return Coder(path, end)


def pieces(df: DataFrame, path: str, shards: int, sizes: Sequence[int] = SIZES, end: str = END) -> DataFrame:
    """shard, doc_id, piece, start, n and ids (bytes): each document's full pieces and its rest, with the end mark. df: doc_id, text."""
    most = max(sizes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, salt = coder(path, end), (TaskContext.get().partitionId() if TaskContext.get() else 0)
        for x in batches if path.endswith(".tiktoken") else bpe.chunks(batches):
            owner, piece, size, parts = [], [], [], []
            for k, ids in enumerate(code.arrays(x["text"].tolist())):
                ids = np.append(ids, code.mark).astype(code.wide)
                for at in range(0, len(ids), most):
                    part = ids[at : at + most]
                    owner.append(k)
                    piece.append(at // most)
                    size.append(len(part))
                    parts.append(part.tobytes())
            made = pd.DataFrame({"doc_id": x["doc_id"].to_numpy()[owner], "piece": piece, "n": size, "ids": parts})
            deal = pd.util.hash_array(np.array(parts, object), categorize=False) ^ pd.util.hash_array(np.array([f"{i} {j} {salt}" for i, j in zip(made["doc_id"], piece, strict=True)], object), categorize=False)
            made["start"], made["shard"] = made["piece"] * np.int64(most), (deal % np.uint64(shards)).astype(np.int64)
            yield made

    return map_frames(df, run, struct(shard="long", doc_id=kind_of(df), piece="int", start="long", n="int", ids="binary"))


def pack_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", sizes: Sequence[int] = SIZES, shard: int = SHARD, end: str = END) -> DataFrame:
    """sequence_id, capacity, n_tokens, ids and docs (doc_id, piece, start: the first token's place in its document, offset: its place in
    the sequence, n_tokens). path: the vocabulary's file."""
    sizes = tuple(sorted(sizes))
    t = texts(df, key, text)
    total = t.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, -(-total // shard))
    dealt = pieces(t, path, shards, sizes, end).repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", F.desc("n"), "doc_id", "piece")
    wide = coder(path, end).wide
    names = ["doc_id", "piece", "start", "offset", "n_tokens"]

    def done(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = pd.concat(held, ignore_index=True)
        b, at, capacity = pack(x["n"].to_numpy(), sizes)
        order = np.lexsort((at, b))
        cuts = np.searchsorted(b[order], np.arange(len(capacity) + 1))
        tokens = np.bincount(b, x["n"], len(capacity)).astype(np.int64)
        docs = [{"doc_id": d, "piece": p, "start": s, "offset": o, "n_tokens": n} for d, p, s, o, n in zip(*(x[c].tolist() for c in names[:3]), at.tolist(), x["n"].tolist(), strict=True)]
        ids, first = x["ids"].tolist(), int(x["shard"].iloc[0]) << 32
        k = 0
        while k < len(capacity):
            stop = max(k + 1, int(np.searchsorted(np.cumsum(tokens[k:]), TOGETHER, "right")) + k)
            own = [order[cuts[j] : cuts[j + 1]] for j in range(k, stop)]
            yield pd.DataFrame({
                "sequence_id": first + np.arange(k, stop),
                "capacity": capacity[k:stop],
                "n_tokens": tokens[k:stop],
                "ids": [np.frombuffer(b"".join(ids[i] for i in o), wide).astype(np.int32) for o in own],
                "docs": [[docs[i] for i in o] for o in own],
            })
            k = stop

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for x in batches:
            for s, part in x.groupby("shard", sort=False):
                if held and held[-1]["shard"].iloc[0] != s:
                    yield from done(held)
                    held = []
                held.append(part)
        if held:
            yield from done(held)

    docs = T.ArrayType(struct(doc_id=kind_of(t), piece="int", start="long", offset="long", n_tokens="long"))
    return map_frames(dealt, run, struct(sequence_id="long", capacity="long", n_tokens="long", ids="array<int>", docs=docs))
