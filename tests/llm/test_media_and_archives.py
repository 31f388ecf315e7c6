import hashlib
import os
import random
import zlib

import pytest
from rows import empty, hard, hard_documents

from docplan.llm import arc_warc, matroska


@pytest.mark.parametrize("n", [64, 4096, 4160, 8192, 32_768, 64 * 777, 64 * 40_000])
def test_matroska_round_trip(n):
    raw = os.urandom(n)
    data = matroska.mux(raw)
    media = matroska.parse(data)
    assert matroska.samples(data, media) == raw
    assert media.tracks[0]["codec"] == "A_PCM/INT/LIT"
    assert media.tracks[0]["depth"] == 8
    at = 0
    for p in media.packets:
        assert p.timestamp_ms == at * 1000 // 8000  # frames of a lace too
        assert p.keyframe
        assert data[p.offset : p.offset + p.size] == raw[at : at + p.size]
        at += p.size
    for _, track, offset in media.cues:
        assert track == 1
        assert data[offset : offset + 4] == bytes.fromhex("1F43B675")


def test_ebml_numbers_and_lacing():
    for value in (0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**35, 2**49):
        data = matroska.number(value)
        assert matroska.read_number(data, 0) == (value, len(data), False)
    assert matroska.read_number(b"\xff", 0)[2]
    r = random.Random(1)
    for _ in range(200):
        sizes = [r.choice((1, 5, 130, 300, 20_000)) for _ in range(r.randint(1, 9))]
        flags, head = matroska.laced(sizes)
        body = b"\x81\x00\x00" + bytes([flags]) + head + bytes(sum(sizes))
        assert [s for _, s in matroska.frames(body, 0, len(body))[3]] == sizes
    xiph = b"\x81\x00\x05\x02" + bytes([2, 255, 45, 7]) + bytes(300 + 7 + 11)
    assert [s for _, s in matroska.frames(xiph, 0, len(xiph))[3]] == [300, 7, 11]


def test_unknown_sizes_and_groups():
    block = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x07\x00abc"))
    cluster = matroska.unsigned(matroska.STAMP, 1000) + block
    unknown = bytes.fromhex("1F43B675") + b"\xff" + cluster
    data = matroska.element(matroska.EBML, b"") + bytes.fromhex("18538067") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + unknown + unknown
    media = matroska.parse(data)
    assert media.clusters == 2
    assert [(p.timestamp_ms, p.size) for p in media.packets] == [(1007, 3)] * 2
    for last in (0x1254C367, 0x114D9B74, 0x1043A770, 0x1941A469):  # what may stand behind a cluster of unknown size
        media = matroska.parse(data + last.to_bytes(4, "big") + b"\x82ab")
        assert (media.clusters, len(media.packets)) == (2, 2)
    with pytest.raises(ValueError, match="parent"):
        matroska.parse(matroska.mux(bytes(64))[:-5])


def test_groups_tell_key_frames_and_durations():
    e, u = matroska.element, matroska.unsigned
    lace = b"\x81\x00\x07\x04\x03" + bytes(8)  # four frames of two bytes; the flag of simple blocks is unset
    plain, refers = e(matroska.BLOCK, lace), u(matroska.REFERENCE, 5)
    for inside, key in ((plain, True), (plain + refers, False)):
        group = e(matroska.GROUP, inside + u(matroska.BLOCK_DURATION, 40))
        data = e(matroska.EBML, b"") + e(matroska.SEGMENT, e(matroska.CLUSTER, u(matroska.STAMP, 100) + group))
        media = matroska.parse(data)
        assert [(p.timestamp_ms, p.size, p.keyframe) for p in media.packets] == [(107 + 10 * k, 2, key) for k in range(4)]
    simple = e(matroska.EBML, b"") + e(matroska.SEGMENT, e(matroska.CLUSTER, e(matroska.SIMPLE, b"\x81\x00\x07\x80ab") + e(matroska.SIMPLE, b"\x81\x00\x09\x00ab")))
    assert [(p.timestamp_ms, p.keyframe) for p in matroska.parse(simple).packets] == [(7, True), (9, False)]


def test_matroska_tables(spark):
    media = matroska.encode(hard(spark))
    got = sorted((r.asDict() for r in matroska.digests(media).collect()), key=str)
    assert len(got) == len(hard_documents())
    for r in hard_documents():
        raw = (r[1] or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        found = [g for g in got if g["doc_id"] == r[0]]
        assert found
        assert {(g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) for g in found} == {(len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))}
    same = [g for g in got if g["doc_id"] in (0, 1)]
    assert len({g["media_sha256"] for g in same}) == len({g["feature"] for g in same}) == 1
    assert matroska.digests(matroska.encode(empty(spark))).count() == 0
    assert matroska.packets(media).where("doc_id = 15").count() > 20


def test_arc_versions():
    for version in (1, 2):
        name = f"v{version}.arc"
        contents = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello\n\nthere", b"plain\n", b"", b"HTTP/1.1 404 Not Found"]
        arc = arc_warc.arc_open(version, name, "20010203040506") + b"".join(arc_warc.arc_record(version, f"http://x/{k}", "1.2.3.4", "20010203", "text/html", c) for k, c in enumerate(contents))
        records = list(arc_warc.arc_parse(arc))
        assert [r.content for r in records[1:]] == contents
        assert list(records[1].fields) == arc_warc.FIELDS[version]
        warcs = [next(arc_warc.warc_parse(arc_warc.convert(r, version))) for r in records]
        assert [w.headers["warc-type"] for w in warcs] == ["warcinfo", "response", "resource", "resource", "response"]
        assert warcs[1].headers["warc-date"] == "2001-02-03T00:00:00Z"
        assert warcs[1].headers["warc-payload-digest"] == arc_warc.digest32(b"hello\n\nthere")
        assert len({w.headers["warc-record-id"] for w in warcs}) == len(warcs)
        with pytest.raises(ValueError, match="inside"):
            list(arc_warc.arc_parse(arc[:-5]))


def test_pages(spark):
    big = "x" * 1200
    rows = [(1, "http://a", big, 0), (2, "http://b c\n", big, 0), (3, None, big, 0), (4, "http://d", "small", 0), (5, "http://e", "small", 0), (6, "http://f", None, 0), (7, "http://g", "", 0), (None, "http://h", "HTTP/1.0 x\r\n\r\n" + "é" * 700, 0), (8, "http://i", "y" * 1000, 0), (8, "http://i", "y" * 1000, 0), (9, "http://j", "z" * 999, 0), (10, "http://k", "z" * 999, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in arc_warc.round_trip(pages).collect()]
    want = []
    for p, _, html, _ in rows:
        raw = (html or "").encode()
        top = max(q for q, _, h, _ in rows if q is not None and h == html) if len(raw) >= 1000 and p is not None else p
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if top == p else "revisit", None if top == p else top))
    assert sorted(got, key=str) == sorted(want, key=str)
    records = arc_warc.read_records(arc_warc.archives(pages)).collect()
    ids = {r["record_id"] for r in records if r["record_type"] != "revisit"}
    assert {r["refers_to_id"] for r in records if r["record_type"] == "revisit"} <= ids  # every revisit's target is in the archives
    links = {r["page_id"]: r for r in arc_warc.round_trip(pages).collect()}
    assert links[3]["record_type"] == "response"
    assert arc_warc.round_trip(pages.limit(0)).count() == 0
