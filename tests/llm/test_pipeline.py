"""The pipeline on the smallest tables, each stage against what it is given; and the queries' SQL."""

import re

import pytest
from compare import assert_same
from test_text_operators import brute_links, brute_repeats, sets_of

from docplan.llm import packing
from docplan.llm.queries import ORACLE, QUERIES, RANKS


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        assert_same(df, data, ORACLE[name])
    else:
        assert df.count() > 0


def test_pipeline(spark, data):
    import corpus_pipeline as p
    from docplan.llm.common import stored

    docs = spark.read.parquet(f"{data}/documents.parquet")
    steps = [docs]
    for name, stage in p.STAGES:
        steps.append(stored(stage(spark, steps[-1], data), re.sub(r"\W", "-", name)))
    for df in steps[1:-1]:
        assert df.dtypes == docs.dtypes
    rows = [[(r["doc_id"], r["text"]) for r in s.select("doc_id", "text").collect()] for s in steps[:-1]]
    toxic = dict(spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic").collect())
    gone = {d for d, _ in rows[0]} - {d for d, _ in rows[1]}
    assert not [d for d in gone if toxic.get(d) == 0]
    linked = brute_links(sets_of(rows[1], 5), 80)
    assert {d for d, _ in rows[2]} == {d for d, n, c, _ in linked if d == c or not n}
    cut = {d: (gone, kept) for d, _, gone, kept in brute_repeats(rows[2], 35)}
    was = dict(rows[2])
    assert all(t == (cut[d][1] if cut[d][0] else was[d]) for d, t in rows[3])
    assert len(rows[3]) == len(rows[4]) == len(rows[2])
    coder = packing.coder(RANKS)
    tokens = {d: len(ids) + 1 for (d, _), ids in zip(rows[4], coder.arrays([t for _, t in rows[4]]), strict=True)}
    packed = {}
    for r in steps[5].collect():
        for d in r["docs"]:
            packed[d["doc_id"]] = packed.get(d["doc_id"], 0) + d["n_tokens"]
    assert packed == tokens
    assert not [t for _, t in rows[4] if re.search(r"[\w.]+@[\w]+\.example", t)]
