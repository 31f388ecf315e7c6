"""Texts far beyond a batch: what stands at their end counts like what stands at their start."""

import hashlib

from test_models import labelled

from docplan.llm import arc_warc, bpe, common, matroska, packing, pii, quality, superkmer, toxicity
from docplan.llm.queries import RANKS, TOKENIZERS

FILL = " ".join(f"plain{k % 977} word{k % 13}" for k in range(180_000))


def test_batches_are_cut(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    assert len(FILL) > common.BATCH_BYTES
    df = spark.createDataFrame([(k, FILL if k % 5 == 0 else "x" * 200_000) for k in range(20)], "id long, text string").coalesce(1)
    got = common.map_batches(df, sizes, common.struct(rows="long", bytes="long")).collect()
    assert sum(r["rows"] for r in got) == 20
    assert all(r["rows"] == 1 or r["bytes"] <= 1.01 * common.BATCH_BYTES for r in got)


def test_ends_count(spark):
    texts, toxic, good = labelled(300)
    tagger = toxicity.fit(texts, toxic.astype(int))
    model = quality.fit(texts, good.astype(int))
    end = " vileword nastyword vileword"
    df = spark.createDataFrame([(1, FILL), (2, FILL + end), (3, "vileword " + FILL)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(df, tagger).collect()}
    spans = {d: {(df_text[s["start"] : s["end"]]) for s in got[d]["spans"]} for d, df_text in ((1, FILL), (2, FILL + end), (3, "vileword " + FILL))}
    assert spans[1] == set()
    assert any("vileword" in s for s in spans[2])
    assert any(s.startswith("vileword") for s in spans[3])
    assert got[2]["score"] > got[1]["score"]
    want = model.scores([FILL, FILL + end, "vileword " + FILL])
    assert len(want) == 3
    field = pii.fit(["card 4111 1111 1111 1111 mail a@b.example"] * 20)
    found = pii.all_spans(field, [FILL + " a@b.example 10.1.2.3 " + "@" * 100_000])[0][0]
    assert [pii.KINDS[s.kind] for s in found] == ["email", "ip"]


def test_long_texts_pass_whole(spark):
    text = FILL + " the end"
    df = spark.createDataFrame([(1, text), (2, "y" * 3_000_000), (3, None)], "doc_id long, text string")
    media = {r["doc_id"]: r for r in matroska.digests(matroska.encode(df)).collect()}
    for d, t in ((1, text), (2, "y" * 3_000_000)):
        raw = t.encode()
        pad = raw + bytes(-len(raw) % 64)
        assert (media[d]["n_bytes"], media[d]["payload_sha256"]) == (len(raw), hashlib.sha256(pad).hexdigest())
    pages = spark.createDataFrame([(1, "http://a", text), (2, "http://b", text), (3, "http://c", None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in arc_warc.round_trip(pages).collect()}
    assert got == {1: (len(text), "revisit", 2), 2: (len(text), "response", None), 3: (0, "response", None)}
    packed = packing.pack_documents(df, RANKS).collect()
    own = sorted((d["start"], r["ids"][d["offset"] : d["offset"] + d["n_tokens"]]) for r in packed for d in r["docs"] if d["doc_id"] == 1)
    code = packing.coder(RANKS)
    assert [i for _, ids in own for i in ids] == [*next(code.arrays([text])).tolist(), code.mark]
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.digests(df, f"{TOKENIZERS}/word_bpe_49k.json").collect()}
    assert n[1] > 360_000
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in superkmer.remove_repeats(df).collect()}
    assert cut[2] == (1, 0)
    assert cut[1][0] == 360_002
    assert cut[1][1] > 300_000  # its words come round again
