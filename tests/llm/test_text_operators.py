import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import LONG, empty, hard, hard_documents, prose

from docplan.llm import bpe, jaccard_join, packing, pii, superkmer
from docplan.llm.common import components
from docplan.llm.queries import TOKENIZERS

VOCABULARY = f"{TOKENIZERS}/word_bpe_49k.json"

# ---- BPE


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aeinorst 'sdm<|>\n"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_bpe_as_the_library(library, many):
    many = [*many, "<|startoftext|>it's<|endoftext|> ΟΔΟΣ", "aaaaaaa aaaaaaaa"]
    for text, (n, ids, said) in zip(many, bpe.encoder(VOCABULARY).encode(many), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want))
        assert n == len(want)
        assert said == library.decode(want, skip_special_tokens=False) == bpe.decode(VOCABULARY, want)


def test_bpe_tables(spark, library):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(hard(spark), VOCABULARY).collect()}
    for r in hard_documents():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        assert (r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) in got
    assert bpe.tokenize(hard(spark), VOCABULARY).count() == len(hard_documents())
    assert bpe.digests(empty(spark), VOCABULARY).count() == 0


# ---- Jaccard join


def sets_of(rows, n, key=0):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        out.append((r[key], frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()))
    return out


def brute_links(sets, percent):
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i), d), links[i]) for i, (d, s) in enumerate(sets)]


def near_copies(seed, groups, each, words=60):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        base = prose(seed * 1000 + g, words).split()
        for _ in range(each):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"q{r.randrange(50)}"
            out.append(" ".join(w))
    r.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 400_000), (5, 80, 400_000), (4, 70, 600), (2, 85, 900)])
def test_links(spark, n, percent, block):
    rows = [(r[0], r[1]) for r in hard_documents()] + near_copies(3, 12, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.link(df, n=n, percent=percent, block=block).collect()]
    assert sorted(got, key=str) == sorted(brute_links(sets_of(rows, n), percent), key=str)


def test_links_of_nothing(spark):
    assert jaccard_join.link(empty(spark)).count() == 0
    assert jaccard_join.link(hard(spark)).count() == len(hard_documents())


def test_join_block_derives_answers():
    r = random.Random(5)
    base = [r.randrange(10**9) for _ in range(120)]
    sets = [np.unique(np.array([*(x for x in base if r.random() > 0.02 * r.randrange(8)), *(r.randrange(10**9) for _ in range(r.randrange(12)))], np.int64)) for _ in range(80)]
    n, weight = np.array([len(s) + r.randrange(3) for s in sets]), np.array([r.randrange(1, 4) for _ in sets])
    forest, links = jaccard_join.join_block(sets, n, weight)
    want = np.zeros(len(sets), int)
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if i != j and 100 * both >= 85 * (n[i] + n[j] - both):
                want[i] += weight[j]
                label = [label[j] if x == label[i] else x for x in label]
    assert links.tolist() == want.tolist()
    mine = list(range(len(sets)))
    for a, b in forest:
        mine = [mine[b] if x == mine[a] else x for x in mine]
    assert [mine.index(x) for x in mine] == [label.index(x) for x in label]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 300), (300, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- repeated windows


def brute_repeats(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = {}
    for w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shared_passages(seed):
    r = random.Random(seed)
    passages = [prose(seed + k, 50) for k in range(3)]
    return [(500 + k, " ".join([prose(seed * 77 + k, r.randrange(30)), r.choice(passages), prose(seed * 99 + k, r.randrange(30))])) for k in range(40)]


@pytest.mark.parametrize(("window", "seed", "hot"), [(35, 12, 2000), (35, 12, 2), (8, 3, 5), (4, 4, 1)])
def test_repeats(spark, window, seed, hot):
    rows = [(r[0], r[1]) for r in hard_documents() if r[1] != LONG or window > 4] + shared_passages(window)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in superkmer.remove_repeats(df, window=window, seed=seed, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(brute_repeats(rows, window), key=str)


def test_cut_keeps_rows(spark):
    cut = {r["doc_id"]: r for r in superkmer.cut_repeats(hard(spark)).collect()}
    was = {r[0]: r for r in hard_documents()}
    assert set(cut) == set(was)
    assert cut[11]["text"] == was[11][1]  # nothing is cut, letter by letter
    assert cut[6]["text"] is None
    assert cut[0]["text"] == ""
    assert (cut[7]["row"], cut[7]["key"], cut[7]["n"]) == ("r", "x", 7)
    assert superkmer.cut_repeats(empty(spark)).count() == 0


# ---- packing


def test_pack_best_fit():
    r = np.random.default_rng(2)
    n = np.minimum(8192, r.lognormal(5.5, 1.3, 4000).astype(int) + 1)
    bins, at, capacity = packing.pack(n)
    used = np.bincount(bins, n)
    assert (used <= capacity).all()
    assert n.sum() / capacity.sum() > 0.97
    for b in range(0, len(used), 50):
        own = sorted((at[i], n[i]) for i in np.flatnonzero(bins == b))
        assert own[0][0] == 0
        assert all(x + k == y for (x, k), (y, _) in zip(own[:-1], own[1:], strict=True))
    smaller = [max((s for s in packing.SIZES if s < c), default=0) for c in capacity]
    assert (used > smaller).all()  # each bin is as small as its contents allow
    assert packing.pack([])[0].size == 0
    assert set(packing.pack([600] * 10)[2]) <= set(packing.SIZES)


def brute_pack(lengths, sizes):
    """Best fit by looking at every bin, and at every size by trying what would still go in."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, where = [], {}  # bins: [capacity, used, step that filled it last]
    for k, i in enumerate(order):
        n = lengths[i]
        rooms = [c - u for c, u, _ in bins if c - u >= n]
        if rooms:
            b = max((j for j, (c, u, _) in enumerate(bins) if c - u == min(rooms)), key=lambda j: bins[j][2])
        else:
            costs = []
            for s in [s for s in sizes if s >= n]:
                short = sorted(m for m in (lengths[j] for j in order[k + 1 :]) if m <= s - n)
                filled = n + min(s - n, sum(short))
                costs.append((packing.cost(min(z for z in sizes if z >= filled)) / filled, s))
            least = min(c for c, _ in costs)
            b = len(bins)
            bins.append([next(s for c, s in costs if c <= least + 1e-12), 0, k])
        where[i] = (min(rooms) if rooms else None, bins[b][0])
        bins[b][1:] = [bins[b][1] + n, k]
    return where, sorted((min(z for z in sizes if z >= u), u) for _, u, _ in bins)


@pytest.mark.parametrize("seed", range(12))
def test_each_placement_is_the_best_fit(seed):
    r = random.Random(seed)
    sizes = (16, 32, 64, 128)
    lengths = [r.choice((r.randrange(1, 129), r.randrange(1, 20), 8)) for _ in range(r.randrange(1, 90))]  # with ties
    bins, at, capacity = packing.pack(lengths, sizes)
    used = np.bincount(bins, lengths, len(capacity)).astype(int)
    _, want = brute_pack(lengths, sizes)
    assert sorted(zip(capacity.tolist(), used.tolist(), strict=True)) == want
    # replay: each piece went where least room was left, or no open bin had room
    opened, room, seen = {}, {}, set()
    where, _ = brute_pack(lengths, sizes)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b, (least, size) = bins[i], where[i]
        if b in seen:
            assert room[b] == least
        else:
            assert least is None
            room[b] = opened[b] = size
            seen.add(b)
        assert at[i] == opened[b] - room[b]
        room[b] -= lengths[i]


def test_pack_tables(spark):
    from docplan.llm.queries import RANKS, TOKENIZERS

    words = f"{TOKENIZERS}/word_bpe_49k.json"
    for path, sizes, shard in ((RANKS, (16, 64, 256), 300), (RANKS, (8192,), 10**9), (words, (16, 64, 256), 300)):
        coder = bpe.Encoder(words) if path == words else packing.coder(path)
        mark = packing.coder(path).mark
        assert mark == (bpe.vocabulary(words).special[packing.END] if path == words else 50256)
        got = packing.pack_documents(hard(spark), path, sizes=sizes, shard=shard).collect()
        assert len({r["sequence_id"] for r in got}) == len(got)
        parts = {}
        for r in got:
            assert len(r["ids"]) == r["n_tokens"] <= r["capacity"]
            assert r["capacity"] == min(s for s in sizes if s >= r["n_tokens"])
            at = 0
            for d in r["docs"]:
                assert d["offset"] == at
                at += d["n_tokens"]
                parts.setdefault((d["doc_id"], d["piece"], d["start"]), []).append(r["ids"][d["offset"] : at])
            assert at == r["n_tokens"]
        want = {}
        for r in hard_documents():
            ids = [*next(coder.arrays([r[1] or ""])).tolist(), mark]
            for k in range(0, len(ids), max(sizes)):
                want.setdefault((r[0], k // max(sizes), k), []).append(ids[k : k + max(sizes)])
        assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack_documents(empty(spark), words).count() == 0


# ---- personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab@.-+% 0123456789()\n"), max_size=80))
def test_base_spans(text):
    assert [tuple(s) for s in pii.base_spans(text)] == brute_spans(text)


def test_skip_links_bring_labels():
    train = [f"{prose(k, 6)} {4111111111111111 if k % 2 else 5500005555555559} {prose(k + 1, 6)} u{k}@mail.example.com" for k in range(60)]
    field = pii.fit(train)
    text = "card 4111 1111 1111 1111 and later 4111.1111.1111.1111, order 12345678"
    (base, more), (none, alone) = pii.all_spans(field, [text, "order 12345678 of 2024.01.02"])
    assert [text[s.start : s.end] for s in base] == ["4111 1111 1111 1111"]
    assert [(pii.KINDS[s.kind], text[s.start : s.end]) for s in more] == [("card", "4111.1111.1111.1111")]
    assert (none, alone) == ([], [])
    assert pii.cover(text, [*base, *more]) == "card [CARD] and later [CARD], order 12345678"


def test_belief_on_a_chain_is_exact():
    r = np.random.default_rng(1)
    unary, pair = r.normal(size=(4, 3)), r.normal(size=(3, 3))
    edges = np.array([(0, 1), (1, 2), (2, 3)])
    got = pii.belief(unary, [(edges, pair), (np.empty((0, 2), np.int64), pair)], rounds=200)
    want = np.zeros((4, 3))
    for a in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(unary[i, a[i]] for i in range(4)) + sum(pair[a[i], a[i + 1]] for i in range(3)))
        for i in range(4):
            want[i, a[i]] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def test_pii_tables(spark):
    field = pii.train(hard(spark))
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base"]) for r in pii.find(hard(spark), field).collect()}
    for r in hard_documents():
        spans = brute_spans(r[1] or "")
        assert (r[0], *(sum(s[0] == k for s in spans) for k in range(4)), ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)) in got
    cut = {r["doc_id"]: r["text"] for r in pii.redact(hard(spark), field).collect()}
    assert cut[18].startswith("write [EMAIL] or [IP], call [PHONE], card [CARD] and")
    assert cut[6] is None
    assert pii.find(empty(spark), pii.train(empty(spark))).count() == 0
    assert pii.redact(empty(spark), field).count() == 0


def test_byte_ids_lose_nothing():
    import base64

    from docplan.llm.queries import RANKS

    with open(RANKS, "rb") as f:
        token = {int(n): base64.b64decode(t) for t, n in map(bytes.split, f)}
    for r in hard_documents():
        ids = next(packing.coder(RANKS).arrays([r[1] or ""])).tolist()
        assert b"".join(token[i] for i in ids).decode() == (r[1] or "")
