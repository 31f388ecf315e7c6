"""N-gram Jaccard join by set-relation skipping.

Two documents link when the Jaccard similarity of their sets of word shingles is at least `percent` / 100, exactly, in integers, over
shingles as 64-bit numbers. The join runs on distinct sets; equal sets are one with a weight.

1. Every shingle goes once to the bucket of its number, packed with others of its bucket; shingles that occur again in a batch go as
   one. Buckets tell which shingles occur in more than one text, and how often. Only sets whose shared shingles could reach the
   threshold stay: in ordinary prose few do, and of those only the shared shingles matter from here on.
2. A set's shared shingles are ordered by frequency, rare ones first; two linked sets share a shingle of their prefixes. Sets are at home
   in blocks: by their least shingle and their size, large homes cut up. The prefix lists tell, for each shingle, which blocks have it,
   how much overlap may be left behind it there, and the least size; a set visits the other blocks of its lists that can hold a partner.
   So lists are looked up by block, not by row, and neither a crowded list nor a chain of lists makes one large task.
3. Each block, with its visitors dealt out in chunks, is joined in one task over index lists that are cut into blocks by position:
   blocks whose positions can't leave enough overlap are skipped whole. The answers of a set are derived from those of a highly similar
   set that is already answered: known overlaps are corrected by the lists of the few shingles in which the two differ.
4. Tasks return a spanning forest of the links that they found, and each set's number of links; components() finishes the classes.

Neither the number of partitions nor how the rows lie in them changes the result. Documents without words or text have empty sets and
link with nothing; with fewer words than a shingle, the whole sequence is one. Texts are taken whole; batches are bounded by bytes, so
memory grows with the longest text alone. Rows may repeat, also with equal identifiers. A null identifier takes part like any other, but
the smallest of a class is taken among those that aren't null. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, kind_of, map_frames, partitions, rows_of, stored, struct, texts
from .superkmer import flat_words, hashes, mixed

N = 4
PERCENT = 85
#: Shingles of a block, and of the visitors that meet it in one task.
BLOCK = 25_000
#: Buckets of shingles for each partition; a task holds one at a time.
BUCKETS = 8
#: Positions of a block of an index list.
SKIP = 16

_lower = {c: c + 32 for c in range(65, 91)}
_upper = re.compile("[A-Z]")


def lower(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.lower() if text.isascii() else text.translate(_lower) if _upper.search(text) else text


def shingles(many: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, laid end to end, and where each text's begin, with the end."""
    flat, starts = flat_words([lower(t) for t in many])
    counts = np.diff(starts)
    h = hashes(flat)
    owner = np.repeat(np.arange(len(many)), counts)
    short = (counts < n) & (counts > 0)
    code = np.zeros(len(h), np.uint64)
    for j in range(n):  # words behind a text's end count as a number of their own, so short sequences differ from long ones
        inside = np.zeros(len(h), bool)
        inside[: len(h) - j] = owner[: len(h) - j] == owner[j:] if j else True
        code = code * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, np.roll(h, -j), np.uint64(0x5851F42D4C957F2D))
    at = np.arange(len(h))
    keep = (at + n <= starts[owner + 1]) | (short[owner] & (at == starts[owner]))
    code, owner = mixed(code[keep]), owner[keep]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    code, owner = code[new], owner[new]
    return code, np.searchsorted(owner, np.arange(len(many) + 1))


def digest(codes: np.ndarray) -> bytes:
    """128 bits of a set of hashes."""
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least intersection with a set that is large enough to link with one of n."""
    return -(-percent * n // 100)


def width(buckets: int) -> int:
    """Bytes of a code that its bucket doesn't tell: the bucket is the remainder, the quotient travels."""
    return (64 - (buckets.bit_length() - 1) + 7) // 8


def packed(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The quotients of codes, a row of bytes each."""
    return np.ascontiguousarray((codes // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width(buckets)])


def unpacked(data: bytes, bucket: int | np.ndarray, buckets: int) -> np.ndarray:
    """The codes of packed quotients of a bucket, or of one bucket each."""
    out = np.zeros((len(data) // width(buckets), 8), np.uint8)
    out[:, : width(buckets)] = np.frombuffer(data, np.uint8).reshape(len(out), width(buckets))
    return out.reshape(-1).view("<u8").astype(np.uint64) * np.uint64(buckets) + np.asarray(bucket).astype(np.uint64)


def level(count: np.ndarray) -> np.ndarray:
    """A frequency as a byte, eight to a doubling: an order by it needs no more."""
    return np.minimum(255, 8 * np.log2(np.maximum(count, 1))).astype(np.uint8)


def by_run(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows again, but no run of equal keys is cut: each frame holds one or more whole runs."""
    rest: list[pd.DataFrame] = []
    for x in batches:
        last = np.logical_and.reduce([(x[k] == x[k].iloc[-1]).to_numpy(bool) for k in keys])
        if not last.all() or rest and (rest[-1][keys].iloc[-1] != x[keys].iloc[0]).any():
            head = pd.concat([*rest, x[~last]], ignore_index=True)
            if len(head):
                yield head
            rest = []
        rest.append(x[last])
    if rest:
        yield pd.concat(rest, ignore_index=True)


# ---- 1. shared shingles

DOC, BATCH, BUCKET = 0, 1, 2
_columns = ["kind", "bucket", "batch", "doc_id", "set", "n", "a", "b", "c"]


def _scatter(t: DataFrame, n: int, buckets: int) -> DataFrame:
    """From each batch: DOC rows (doc_id, set, n); a BATCH row with the sets (a: digests, b: sizes) and, by set, the shingles that the
    batch has in more than one (c: sets, then codes); and for each bucket a BUCKET row with the codes it gets, one for each distinct
    shingle (a), the set of each (b) and whether the batch has it again (c)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            codes, at = shingles(x["text"].tolist(), n)
            size = np.diff(at)
            sets = [digest(codes[a:b]) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            first: dict[bytes, int] = {}
            for i, s in enumerate(sets):
                if s is not None:
                    first.setdefault(s, i)
            yield pd.DataFrame({"kind": DOC, "bucket": np.arange(len(x)) % buckets, "batch": 0, "doc_id": x["doc_id"], "set": sets, "n": size, "a": None, "b": None, "c": None})
            if not first:
                continue
            chosen = np.array(list(first.values()))
            number = np.full(len(sets), -1)
            number[chosen] = np.arange(len(chosen))
            owner = number[np.repeat(np.arange(len(sets)), size)]
            codes, owner = codes[owner >= 0], owner[owner >= 0]
            order = np.argsort(codes, kind="stable")
            codes, owner = codes[order], owner[order]
            new = np.ones(len(codes), bool)
            new[1:] = codes[1:] != codes[:-1]
            known = ~new
            known[:-1] |= ~new[1:]
            batch = int.from_bytes(hashlib.blake2b(b"".join(first), digest_size=8).digest(), "big", signed=True)
            rows = [(BATCH, batch % buckets, batch, None, None, len(chosen), b"".join(first), size[chosen].astype("<u4").tobytes(), owner[known].astype("<u2").tobytes() + codes[known].astype("<u8").tobytes())]
            codes, owner, known = codes[new], owner[new], known[new]
            bucket = (codes % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            codes, owner, known, bucket = packed(codes[order], buckets), owner[order].astype("<u2"), known[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if hi > lo:
                    rows.append((BUCKET, b, batch, None, None, hi - lo, codes[lo:hi].tobytes(), owner[lo:hi].tobytes(), np.packbits(known[lo:hi]).tobytes()))
            yield rows_of(rows, _columns)

    return map_frames(t, run, struct(kind="int", bucket="int", batch="long", doc_id=kind_of(t), set="binary", n="int", a="binary", b="binary", c="binary"))


def _buckets(dealt: DataFrame, buckets: int) -> DataFrame:
    """BUCKET rows come back with only the shingles that another set has as well (a: codes, b: sets) and about how often each occurs
    (c), a set twice where its batch has it again; the other rows as they are."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in by_run(batches, ["bucket"]):
            plain = x[x["kind"] != BUCKET]
            if len(plain):
                yield plain[_columns]
            for b, part in x[x["kind"] == BUCKET].groupby("bucket"):
                size = part["n"].to_numpy(int)
                quotients = np.frombuffer(b"".join(part["a"]), np.uint8).reshape(int(size.sum()), width(buckets))
                every = unpacked(quotients.tobytes(), b, buckets)
                known = np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8), count=k) for c, k in zip(part["c"], size.tolist(), strict=True)])
                _, place, count = np.unique(every, return_inverse=True, return_counts=True)
                count = (count + np.bincount(place, known, len(count)).astype(np.int64))[place]
                at, rows = 0, []
                for batch, k, owners in zip(part["batch"], size.tolist(), part["b"], strict=True):
                    often = count[at : at + k]
                    mine = often > 1
                    if mine.any():
                        rows.append((BUCKET, b, batch, None, None, int(mine.sum()), quotients[at : at + k][mine].tobytes(), np.frombuffer(owners, "<u2")[mine].tobytes(), level(often[mine]).tobytes()))
                    at += k
                if rows:
                    yield rows_of(rows, _columns)

    return map_frames(dealt.sortWithinPartitions("bucket"), run, dealt.schema)


def _gather(told: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(set, n, codes): the sets of each batch with enough shared shingles to link with any other, rare shingles first."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in by_run(batches, ["batch"]):
            rows = []
            for _, part in x.groupby("batch"):
                head = part[part["kind"] == BATCH].iloc[0]  # equal batches, of repeated rows, have one number and the same sets
                m = int(head["n"])
                rest = np.frombuffer(head["c"], np.uint8)
                k = len(rest) // 10
                answers = part[part["kind"] == BUCKET]
                heard, often = unpacked(b"".join(answers["a"]), np.repeat(answers["bucket"].to_numpy(np.int64), answers["n"].to_numpy(np.int64)), buckets), np.frombuffer(b"".join(answers["c"]), np.uint8)
                order = np.argsort(heard, kind="stable")
                heard, often, first = heard[order], often[order], np.frombuffer(b"".join(answers["b"]), "<u2")[order]
                owner = np.concatenate([rest[: 2 * k].view("<u2"), first]).astype(np.int64)
                code = np.concatenate([rest[2 * k :].copy().view("<u8"), heard])
                n = np.frombuffer(head["b"], "<u4").astype(np.int64)
                order = np.lexsort((code, owner))
                owner, code = owner[order], code[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
                owner, code = owner[new], code[new]
                order = np.lexsort((code, often[np.searchsorted(heard, code)] if len(code) else code, owner))
                owner, code = owner[order], code[order].view(np.int64)
                at = np.searchsorted(owner, np.arange(m + 1))
                for i in np.flatnonzero(np.diff(at) >= least_overlap(n, percent)).tolist():
                    rows.append((head["a"][16 * i : 16 * i + 16], int(n[i]), code[at[i] : at[i + 1]]))
            if rows:
                yield rows_of(rows, ["set", "n", "codes"])

    return map_frames(told.repartition(partitions(told), "batch").sortWithinPartitions("batch"), run, struct(set="binary", n="int", codes="array<bigint>"))


# ---- 2. blocks and their visitors


def _blocks(some: DataFrame, percent: int, block: int) -> DataFrame:
    """some with the block that each set is at home in: by its least shingle and the class of its size. A home is cut into as many blocks
    as it needs; only homes that need several are joined."""
    step = max(math.log(100 / percent), 1e-9) * 1.0001
    at = some.withColumn("home", F.array_min("codes")).withColumn("class", F.floor(F.log("n") / step))
    large = at.groupBy("home", "class").agg(F.ceil(F.sum(F.size("codes")) / block).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("set"), F.coalesce("parts", F.lit(1)))
    return at.join(large, ["home", "class"], "left").withColumn("block", F.xxhash64("home", "class", part)).select("set", "n", "codes", "c", "block")


def _visits(homes: DataFrame, percent: int) -> DataFrame:
    """(sid, block): the other blocks where a set may have a partner. Of two blocks the set of the larger number visits. sid is a hash
    of the set, which keeps the lists' rows short; two sets that share one visit what either would, which costs time only."""
    prefix = F.greatest(F.lit(0), F.size("codes") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    lists = homes.select(F.xxhash64("set").alias("sid"), "n", "block", F.size("codes").alias("m"), F.posexplode(F.slice("codes", 1, prefix)).alias("at", "code"))
    lists = lists.select("code", "sid", "n", "block", (F.col("m") - F.col("at")).alias("left"))
    spots = lists.groupBy("code", "block").agg(F.max("left").alias("spot_left"), F.min("n").alias("spot_n")).withColumnRenamed("block", "spot")
    # an overlap behind the first shared shingle is at most what both have left there, and links need percent / (100 + percent) of both sizes
    enough = F.least("left", "spot_left").cast("long") * (100 + percent) >= (F.col("n").cast("long") + F.col("spot_n")) * percent
    met = lists.join(spots, "code").where((F.col("spot") < F.col("block")) & enough)
    return met.select("sid", F.col("spot").alias("block")).distinct()


def _deal(homes: DataFrame, visits: DataFrame, block: int) -> DataFrame:
    """block, chunk, visitor, set, n, codes, c: each block with each chunk of its visitors; blocks of one set without visitors are left out."""
    plain = homes.select("block", "set", "n", "codes", "c")
    own = plain.withColumn("sid", F.xxhash64("set")).withColumnRenamed("block", "home")
    guests = visits.join(own, "sid").where("block <> home").drop("sid", "home")
    load = guests.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("codes")) / block)).alias("chunks"))
    busy = plain.groupBy("block").agg(F.count("*").alias("members")).join(load, "block", "left").where("members > 1 OR chunks IS NOT NULL")
    members = plain.join(busy.select("block", F.coalesce("chunks", F.lit(1)).alias("chunks")), "block")
    members = members.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("visitor", F.lit(0)).drop("chunks")
    guests = guests.join(load.where("chunks > 1"), "block", "left").withColumn("chunk", F.pmod(F.xxhash64("set", F.lit(1)), F.coalesce("chunks", F.lit(1)))).withColumn("visitor", F.lit(1)).drop("chunks")
    return members.unionByName(guests)


# ---- 3. the join of a block with its visitors


def numbered(group: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each different (group, code), and how often each occurs."""
    order = np.lexsort((code, group))
    group, code = group[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (group[1:] != group[:-1])
    token = np.empty(len(code), np.int64)
    token[order] = np.cumsum(new) - 1
    return token, np.bincount(token, minlength=int(new.sum()))


class Block:
    """Sets of shared shingles with index lists over them. Sets of different groups share nothing."""

    def __init__(self, codes: list[np.ndarray], n: np.ndarray, group: np.ndarray, percent: int = PERCENT, slack: int = 8) -> None:
        self.n, self.percent, self.slack = n.astype(np.int64), percent, slack
        size = np.array([len(c) for c in codes], np.int64)
        owner = np.repeat(np.arange(len(codes)), size)
        token, count = numbered(group[owner], np.concatenate(codes) if codes else np.empty(0, np.int64))
        keep = count[token] > 1  # alone here: no overlap
        owner, token, own = owner[keep], token[keep], count
        rank = np.empty(len(own), np.int64)
        rank[np.lexsort((np.arange(len(own)), own))] = np.arange(len(own))  # rare ones first
        token = rank[token]
        order = np.lexsort((token, owner))
        self.owner, self.token = owner[order], token[order]
        self.at = np.searchsorted(self.owner, np.arange(len(codes) + 1))
        alone = self.n - np.diff(self.at)  # these come first in a set's order
        self.position = np.arange(len(self.token)) - self.at[self.owner] + alone[self.owner]
        by = np.argsort(self.token, kind="stable")
        self.lists, self.list_at = self.owner[by], np.searchsorted(self.token[by], np.arange(len(own) + 1))
        # index lists: prefixes only, by token and then by block of positions; reach is the largest overlap that a block's entries allow
        need = least_overlap(self.n, percent) - slack
        entry = np.flatnonzero(self.position <= (self.n - need)[self.owner])
        entry = entry[np.lexsort((self.position[entry], self.token[entry]))]
        skip = self.position[entry] // SKIP
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(self.token[entry]) != 0) | (np.diff(skip) != 0)))) if len(entry) else np.empty(0, np.int64)
        self.posting = self.owner[entry]
        self.block_at = np.append(cut, len(entry))
        self.reach = np.maximum.reduceat((self.n[self.posting] - self.position[entry]), cut) if len(cut) else np.empty(0, np.int64)
        self.block_of = np.searchsorted(self.token[entry][cut] if len(cut) else np.empty(0, np.int64), np.arange(len(own) + 1))
        self.mark = np.zeros(len(own), np.int64)
        self.place = np.full(len(codes), -1)

    def tokens(self, i: int) -> np.ndarray:
        return self.token[self.at[i] : self.at[i + 1]]

    def candidates(self, x: int) -> np.ndarray:
        """Sets that may overlap with x by the threshold less the slack."""
        need = int(least_overlap(self.n[x], self.percent)) - self.slack
        prefix = self.tokens(x)[: max(0, int(self.n[x]) - need + 1 - int(self.n[x] - (self.at[x + 1] - self.at[x])))]
        parts = []
        for a, b in zip(self.block_of[prefix].tolist(), self.block_of[prefix + 1].tolist(), strict=True):
            for k in range(a, b):
                if self.reach[k] >= need:
                    parts.append(self.posting[self.block_at[k] : self.block_at[k + 1]])
        found = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
        n, m = self.n[found], self.n[x]
        return found[(n * 100 >= m * self.percent - 100 * self.slack) & (m * 100 + 100 * self.slack >= n * self.percent)]

    def overlaps(self, x: int, found: np.ndarray) -> np.ndarray:
        self.mark[self.tokens(x)] = 1
        size = self.at[found + 1] - self.at[found]
        ends = np.cumsum(size)
        take = np.arange(ends[-1]) - np.repeat(ends - size - self.at[found], size)
        total = np.concatenate(([0], np.cumsum(self.mark[self.token[take]])))
        self.mark[self.tokens(x)] = 0
        return total[ends] - total[ends - size]

    def answers(self, seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each seed the other sets that it links with."""
        done = np.ones(len(self.n), bool)
        done[seeds] = False
        for x in seeds[np.argsort(self.n[seeds], kind="stable")].tolist():
            if done[x]:
                continue
            found = self.candidates(x)
            if not len(found):
                done[x] = True
                continue
            overlap = self.overlaps(x, found)
            self.place[found] = np.arange(len(found))
            near = found[(self.n[x] - overlap <= self.slack) & (self.n[found] - overlap <= self.slack) & (self.n[found] >= self.n[x]) & ~done[found]]
            for y in dict.fromkeys([x, *near.tolist()]):
                own = overlap if y == x else self._derived(x, y, overlap)
                n = self.n[found] + self.n[y]
                done[y] = True
                yield y, found[(100 * own >= self.percent * (n - own)) & (found != y)]
            self.place[found] = -1

    def _derived(self, x: int, y: int, overlap: np.ndarray) -> np.ndarray:
        """y's overlaps from x's, by the lists of the shingles in which they differ. x's candidates hold all answers of y: those overlap
        with x by y's threshold less the slack, and y isn't smaller."""
        own = overlap.copy()
        a, b = self.tokens(x), self.tokens(y)
        for tokens, sign in ((np.setdiff1d(a, b, assume_unique=True), -1), (np.setdiff1d(b, a, assume_unique=True), 1)):
            for t in tokens.tolist():
                at = self.place[self.lists[self.list_at[t] : self.list_at[t + 1]]]
                own[at[at >= 0]] += sign
        return own


def join_block(codes: list[np.ndarray], n: np.ndarray, weight: np.ndarray, group: np.ndarray | None = None, visitor: np.ndarray | None = None, inside: np.ndarray | None = None, percent: int = PERCENT) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links between the sets, and the weight of each set's links. Links are within a group: those of members
    with visitors, and where `inside` holds those among members as well."""
    group = np.zeros(len(n), np.int64) if group is None else group
    visitor = np.zeros(len(n), bool) if visitor is None else visitor
    inside = np.ones(len(n), bool) if inside is None else inside
    label, links, forest = np.arange(len(n)), np.zeros(len(n), np.int64), []
    for x, found in Block(codes, n, group, percent).answers(np.flatnonzero(~visitor)):
        guests = found[visitor[found]]
        np.add.at(links, guests, weight[x])  # they don't ask themselves
        if not inside[x]:
            found = guests
        links[x] += weight[found].sum()
        if len(found):
            other, where = np.unique(label[found], return_index=True)
            new = other != label[x]
            if new.any():
                forest += [(x, int(z)) for z in found[where[new]]]
                label[np.isin(label, other[new])] = label[x]
    return forest, links


def _join(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the links' forests, and (a, links). Small blocks of a batch are joined together."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in by_run(batches, ["block", "chunk"]):
            names, block, chunk = x["set"].tolist(), x["block"].to_numpy(np.int64), x["chunk"].to_numpy(np.int64)
            new = np.ones(len(x), bool)
            new[1:] = (block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1])
            forest, links = join_block(x["codes"].tolist(), x["n"].to_numpy(np.int64), x["c"].to_numpy(np.int64), np.cumsum(new), x["visitor"].to_numpy(np.int64) > 0, chunk == 0, percent)
            rows = [(names[i], None, int(k)) for i, k in enumerate(links.tolist()) if k] + [(names[a], names[b], 0) for a, b in forest]
            if rows:
                yield rows_of(rows, ["a", "b", "links"])

    return map_frames(dealt, run, struct(a="binary", b="binary", links="long"))


def link(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links: of each document its set's size, the smallest identifier that it reaches by links,
    and how many other documents it links with. No link is found in more than one task."""
    t = texts(df, key, text)
    parts = partitions(df)
    buckets = BUCKETS * parts  # several for each partition, for hashing deals them out unevenly
    told = stored(_buckets(_scatter(t, n, buckets).repartition(parts, "bucket"), buckets), "shingles")
    docs = told.where(F.col("kind") == DOC).select("doc_id", "set", "n")
    sets = stored(docs.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")), "sets")
    some = _gather(told.where(F.col("kind") != DOC), percent, buckets).groupBy("set").agg(F.first("n").alias("n"), F.first("codes").alias("codes"))
    some = stored(some.join(sets.select("set", "c"), "set"), "some")
    homes = stored(_blocks(some, percent, block), "homes")
    forget(some)
    dealt = _deal(homes, stored(_visits(homes, percent), "visits"), block)
    dealt = dealt.repartition(parts, "block", "chunk").sortWithinPartitions("block", "chunk")
    found = stored(_join(dealt.select("block", "chunk", "visitor", "set", "n", "codes", "c"), percent), "links")
    forget(homes)

    # 4. classes
    near = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("set"), "root")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    whole = sets.join(near, "set", "left").withColumn("root", F.coalesce("root", "set"))
    whole = whole.join(whole.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(links, "set", "left")
    whole = whole.select("set", "component_id", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"))
    return docs.join(whole, "set", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
