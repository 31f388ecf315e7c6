import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import empty, hard, hard_documents, prose

from docplan.llm import ann, quality, toxicity
from docplan.llm.queries import QUERIES


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    y = np.asarray(y) > 0
    return (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / max(1, y.sum() * (~y).sum())


def test_chain_is_exact():
    r = np.random.default_rng(3)
    at = np.array([0, 3, 3, 8, 9])
    u, trans = r.normal(size=9), r.normal(size=(2, 2))
    p, pairs, z = toxicity.chain(u, at, trans, width=4)
    want_p, want_pairs, want_z = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, b in zip(at[:-1], at[1:], strict=True):
        if a == b:
            continue
        total, own, both = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            e = np.exp(sum(u[a + i] * v for i, v in enumerate(y)) + sum(trans[y[i], y[i + 1]] for i in range(len(y) - 1)))
            total += e
            own += e * np.array(y)
            for i in range(len(y) - 1):
                both[y[i], y[i + 1]] += e
        want_p[a:b] = own / total
        want_pairs += both / total
        want_z += np.log(total)
    assert np.allclose(p, want_p)
    assert np.allclose(pairs, want_pairs)
    assert np.isclose(z, want_z)


def labelled(n):
    texts, toxic, good = [], [], []
    for k in range(n):
        t, bad, junk = prose(k, 40), k % 5 == 0, k % 4 == 1
        if bad:
            w = t.split()
            for j in range(2):
                w.insert((k * 7 + j * 11) % len(w), ("vileword", "nastyword")[(k + j) % 2])
            t = " ".join(w)
        if junk:
            t = " | ".join(w + "###" for w in t.split())
        texts.append(t)
        toxic.append(int(bad))
        good.append(int(not junk))
    return texts, np.array(toxic), np.array(good)


def test_toxicity_generalises():
    texts, toxic, _ = labelled(600)
    tagger = toxicity.fit(texts[:400], toxic[:400])
    assert {"vileword", "nastyword"} <= toxicity.toxic_words(texts[:400], toxic[:400])
    s = tagger.scores(*tagger.marginals(texts[400:]))
    assert auc(s, toxic[400:]) > 0.99
    assert ((s >= toxicity.CUT) == toxic[400:]).mean() > 0.98
    p, at = tagger.marginals(["say VILEWORD now", ""])
    assert p.argmax() == 1
    assert tagger.scores(p, at)[1] < toxicity.CUT


def test_quality_generalises():
    texts, _, good = labelled(600)
    model = quality.fit(texts[:400], good[:400])
    s = model.scores(texts[400:])
    assert auc(s, good[400:]) > 0.99
    assert ((s >= 0.5) == good[400:]).mean() > 0.97


def test_dual_descent_is_the_optimum():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(60, 4)), np.where(r.random(60) > 0.5, 1.0, -1.0)
    rows, cost = [(np.arange(4), v) for v in x], np.full(60, 0.7)

    def loss(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    w = quality.dual_descent(rows, y, cost, 4, epochs=500)
    assert all(loss(w) <= loss(w + 0.02 * r.normal(size=4)) + 1e-4 for _ in range(200))


def test_classifier_tables(spark):
    texts, toxic, good = labelled(300)
    docs = spark.createDataFrame([*[(k, t) for k, t in enumerate(texts)], (1000, None), (1001, ""), (None, "x"), (5, texts[5])], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([*[(k, int(g), int(t)) for k, (g, t) in enumerate(zip(good, toxic, strict=True))], (None, 1, 1), (7, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    q = quality.score(docs, labels).collect()
    t = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    import zlib

    for rows, modulus, rest, cut in ((q, 3, 1, 0.5), (t, 4, 2, 0.3)):
        assert len(rows) == 304
        for r in rows:
            assert 0 <= r["score"] <= 1
            assert r["predicted"] == int(r["score"] >= cut)
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
    spans = next(r for r in t if r["doc_id"] == 5)["spans"]
    assert {texts[5][s["start"] : s["end"]] for s in spans} == {"vileword", "nastyword"}
    assert quality.score(hard(spark), labels.limit(0)).count() == len(hard_documents())
    assert quality.score(empty(spark), labels).count() == 0
    tagger = toxicity.train(hard(spark), labels.limit(0))
    assert toxicity.score(empty(spark), tagger).count() == 0
    assert toxicity.keep_clean(hard(spark), tagger).columns == hard(spark).columns


def test_labels_of_the_held_out_fold_teach_nothing(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    turned = labels.withColumn("quality", F.when(crc % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r["doc_id"], r["score"]) for r in quality.score(docs, x).collect()} for x in (labels, turned))
    assert a == b


def brute_neighbours(rows, asked, k):
    out = {}
    for q, v in asked:
        scored = sorted((-float((np.array(v, float) * np.array(x, float)).sum()), i) for i, x in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_ann(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 24))
    x[200:500] = x[200]  # one common vector
    rows = [(int(k), [float(np.float32(v)) for v in x[k]]) for k in range(len(x))]
    odd = [(5001, None), (5002, [0.0] * 24), (5003, [float("nan")] + [1.0] * 23), (5004, [float("inf")] + [1.0] * 23), (5005, [None] + [1.0] * 23), (5006, [1.0] * 3), (5020, [0.0] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("cell", F.lit("x"))
    got = {}
    for row in ann.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    want = brute_neighbours(rows, [(i, v) for i, v in rows if i % 20 == 0], 20)
    assert set(got) == set(want)
    assert all(len(v) == 20 for v in got.values())
    hit = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert hit >= 0.9
    exact = {(i, q): s for q in want for i, s in want[q]}
    assert all(s == pytest.approx(exact[i, q], rel=1e-12) for q in got for i, s in got[q] if (i, q) in exact)
    copies = [i for i, _ in got[220]][:5]
    assert copies == [200, 201, 202, 203, 204]
    few = ann.search(df.where("vec_id < 21"), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(r["rank"] for r in few) == sorted([*range(1, 21)] * 2)
    assert ann.search(df.where("vec_id > 5000"), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_search_over_split_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "ASKED", 5)
    r = np.random.default_rng(6)
    rows = [(int(k), [float(v) for v in r.normal(size=8)]) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for row in ann.search(df, F.col("vec_id") % 20 == 0, 10, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    assert got == {q: [i for i, _ in v] for q, v in brute_neighbours(rows, [(i, v) for i, v in rows if i % 20 == 0], 10).items()}


def test_recall_on_the_table(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, [x for x in rows if x[0] % 20 == 0], 20)
    got = {}
    for r in QUERIES["op2_ivf_pq"](spark, data).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
