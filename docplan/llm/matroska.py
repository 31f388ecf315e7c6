"""Media columns in Matroska: a multiplexer, a parser that makes packet tables, and feature columns.

Nulls count as empty payloads. An empty payload still gives a file with one block of padding. Equal payloads give equal files: the
identifiers in a file depend on nothing else. Very long payloads take more clusters; a task holds a few MB of payloads, or one. Repeated rows give repeated results, an empty table an empty result; columns other than
the key and the payload are ignored."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import kind_of, map_frames, rows_of, texts
from .common import struct as schema

# Element identifiers of the Matroska specification.
EBML, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80
TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, FRAME_NS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, STAMP, SIMPLE, GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUES, POINT, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469

#: Elements that hold elements.
MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, CUE_AT))
#: What may follow a segment or cluster of unknown size.
LEVEL1 = frozenset((INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS))

SAMPLE_RATE = 8000
FRAME = 4096  # samples, 512 ms
LACED = 8  # frames of a block
BLOCKS = 7  # of a cluster: its relative timestamps stay under 2 ** 15 ms


class Packet(NamedTuple):
    track: int
    timestamp_ms: int
    offset: int
    size: int
    cluster: int
    keyframe: bool


class Media(NamedTuple):
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    clusters: int
    duration_ms: float


def number(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, in the least bytes, or in width."""
    n = width or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + number(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(sizes: list[int]) -> tuple[int, bytes]:
    """Lacing flags and the lace header for frames of these sizes: none, fixed, or EBML with signed differences."""
    if len(sizes) == 1:
        return 0, b""
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(sizes) - 1])
    head = bytes([len(sizes) - 1]) + number(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        n = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
        head += number(b - a + (1 << 7 * n - 1) - 1, n)
    return 0x06, head


def mux(payload: bytes, frame: int = FRAME, rate: int = SAMPLE_RATE) -> bytes:
    """A Matroska file that holds payload as one track of 8-bit PCM."""
    head = element(EBML, element(DOCTYPE, b"matroska") + unsigned(DOCTYPE_VERSION, 4) + unsigned(DOCTYPE_READ, 2))
    info = element(INFO, unsigned(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)) + element(APP, b"docplan"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", float(rate))) + unsigned(CHANNELS, 1) + unsigned(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, unsigned(NUMBER, 1) + unsigned(UID, 1 + zlib.crc32(payload)) + unsigned(KIND, 2) + unsigned(FRAME_NS, frame * 10**9 // rate) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    at, body, points = len(info) + len(tracks), [info, tracks], []
    step = frame * LACED
    for start in range(0, len(payload), step * BLOCKS):
        stamp = start * 1000 // rate
        parts = [unsigned(STAMP, stamp)]
        for b in range(start, min(start + step * BLOCKS, len(payload)), step):
            data = payload[b : b + step]
            flags, lace = laced([min(frame, len(data) - k) for k in range(0, len(data), frame)])
            parts.append(element(SIMPLE, b"\x81" + struct.pack(">hB", b * 1000 // rate - stamp, 0x80 | flags) + lace + data))
        cluster = element(CLUSTER, b"".join(parts))
        points.append(element(POINT, unsigned(CUE_TIME, stamp) + element(CUE_AT, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(points)))
    return head + element(SEGMENT, b"".join(body))


def read_number(data: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """The variable-length integer at a place, the place behind it, and whether all its bits are set (an unknown size)."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError(f"no EBML number at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    bits = value & (1 << 7 * n) - 1
    return (value if keep else bits), at + n, bits == (1 << 7 * n) - 1


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, its start, start and end of its body) of the elements between two places."""
    while at < end:
        ident, body, _ = read_number(data, at, keep=True)
        if inside == CLUSTER and ident in LEVEL1:
            return
        size, body, unknown = read_number(data, body)
        stop = end if unknown else body + size
        if unknown and ident == CLUSTER:  # ends where the next element of the segment begins
            for _, _, _, stop in elements(data, body, end, CLUSTER):
                pass
        if stop > end:
            raise ValueError(f"the element at byte {at} ends beyond its parent")
        yield ident, at, body, stop
        at = stop


def frames(data: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Track, relative timestamp, keyframe flag and (offset, size) of the frames in a block's body."""
    track, at, _ = read_number(data, at)
    stamp, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags & 0x06
    if not kind:
        return track, stamp, bool(flags & 0x80), [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == 0x02:  # Xiph: bytes of 255 and a last one
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 0x06 and count > 1:
        size, at, _ = read_number(data, at)
        sizes.append(size)
        for _ in range(count - 2):
            first = at
            more, at, _ = read_number(data, at)
            size += more - ((1 << 7 * (at - first) - 1) - 1)
            sizes.append(size)
    if kind == 0x04:
        sizes = [(end - at) // count] * count
    else:
        sizes.append(end - at - sum(sizes))
    found = []
    for size in sizes:
        found.append((at, size))
        at += size
    if at != end or min(sizes) < 0:
        raise ValueError("the lace sizes don't fit the block")
    return track, stamp, bool(flags & 0x80), found


def parse(data: bytes) -> Media:
    """Tracks, packets with timestamps and byte ranges, and cues (time, track, byte of the cluster) of a Matroska file."""
    tracks: list[dict] = []
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    state = {"scale": 1_000_000, "duration": 0.0, "clusters": 0}

    def value(at: int, end: int) -> int:
        return int.from_bytes(data[at:end], "big")

    def real(at: int, end: int) -> float:
        return struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0] if end > at else 0.0

    for ident, _, at, end in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        base = at
        for kind, _, a, b in elements(data, at, end):
            if kind == INFO:
                for k, _, x, y in elements(data, a, b):
                    if k == SCALE:
                        state["scale"] = value(x, y)
                    elif k == DURATION:
                        state["duration"] = real(x, y)
            elif kind == TRACKS:
                for _, _, c, d in (e for e in elements(data, a, b) if e[0] == ENTRY):
                    track = {"rate": 8000.0, "channels": 1, "depth": 0}
                    for k, _, x, y in elements(data, c, d):
                        if k == AUDIO:
                            for k2, _, x2, y2 in elements(data, x, y):
                                name = {RATE: "rate", CHANNELS: "channels", DEPTH: "depth"}.get(k2)
                                if name:
                                    track[name] = real(x2, y2) if k2 == RATE else value(x2, y2)
                        elif k in (NUMBER, UID, KIND, FRAME_NS):
                            track[{NUMBER: "number", UID: "uid", KIND: "kind", FRAME_NS: "frame_ns"}[k]] = value(x, y)
                        elif k == CODEC:
                            track["codec"] = data[x:y].decode("ascii", "replace")
                    tracks.append(track)
            elif kind == CLUSTER:
                stamp, k_cluster = 0, state["clusters"]
                state["clusters"] += 1
                for k, _, x, y in elements(data, a, b, CLUSTER):
                    if k == STAMP:
                        stamp = value(x, y)
                    if k == SIMPLE:
                        blocks, keyframe, lasts = [(x, y)], None, None
                    elif k == GROUP:  # a key frame refers to no other block; the flag is of simple blocks only
                        inside = [(k2, x2, y2) for k2, _, x2, y2 in elements(data, x, y)]
                        blocks = [(x2, y2) for k2, x2, y2 in inside if k2 == BLOCK]
                        keyframe = all(k2 != REFERENCE for k2, _, _ in inside)
                        lasts = next((value(x2, y2) * state["scale"] for k2, x2, y2 in inside if k2 == BLOCK_DURATION), None)
                    else:
                        continue
                    for x2, y2 in blocks:
                        n, rel, flag, parts = frames(data, x2, y2)
                        # frames of a lace follow each other by the track's default duration, or share their block's
                        step = next((t["frame_ns"] for t in tracks if t.get("number") == n and "frame_ns" in t), None) or (lasts // len(parts) if lasts else 0)
                        at_ns = (stamp + rel) * state["scale"]
                        packets += [Packet(n, (at_ns + j * step) // 1_000_000, o, s, k_cluster, flag if keyframe is None else keyframe) for j, (o, s) in enumerate(parts)]
            elif kind == CUES:
                for _, _, c, d in (e for e in elements(data, a, b) if e[0] == POINT):
                    when = 0
                    for k, _, x, y in elements(data, c, d):
                        if k == CUE_TIME:
                            when = value(x, y)
                        elif k == CUE_AT:
                            got = {k2: value(x2, y2) for k2, _, x2, y2 in elements(data, x, y)}
                            cues.append((when, got.get(CUE_TRACK, 0), base + got.get(CUE_CLUSTER, 0)))
    return Media(tracks, packets, cues, state["clusters"], state["duration"] * state["scale"] / 1e6)


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """The bytes of a track's packets, in file order."""
    return b"".join(data[p.offset : p.offset + p.size] for p in media.packets if p.track == track)


def payload_of(text: str) -> bytes:
    """A text in UTF-8 and zeros up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def features(raw: bytes, media: Media) -> str:
    """Packets, clusters, cues, duration, mean, deviation and sign changes of 8-bit unsigned samples."""
    x = np.frombuffer(raw, np.uint8).astype(np.int16) - 128
    changes = int(np.count_nonzero(np.diff(x >= 0)))
    return f"codec={media.tracks[0]['codec']};packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};ms={media.duration_ms:.3f};mean={x.mean():.4f};dev={x.std():.4f};cross={changes}"


def encode(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text as a Matroska file in a binary column."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = [(len(t.encode("utf-8", "surrogatepass")), mux(payload_of(t))) for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "n_bytes": [n for n, _ in made], "media": [m for _, m in made]})

    t = texts(df, key, text)
    return map_frames(t, run, schema(doc_id=kind_of(t), n_bytes="long", media="binary"))


def packets(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """The packet table of a media column: a row for each frame with its track, timestamp and byte range. Null media give no rows."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for k, m in zip(x[key], x[column], strict=True):
                if m is not None:
                    yield rows_of([(k, *p) for p in parse(bytes(m)).packets], [key, *Packet._fields])

    return map_frames(media.select(key, column), run, schema(**{key: kind_of(media, key)}, track="long", timestamp_ms="long", offset="long", size="long", cluster="long", keyframe="boolean"))


def digests(media: DataFrame) -> DataFrame:
    """Reads encode()'s media back and describes payload and file."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for k, n, m in zip(x["doc_id"], x["n_bytes"], x["media"], strict=True):
                got = parse(m)
                raw = samples(m, got)
                rows.append((k, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(raw, got)))
            yield rows_of(rows, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    out = schema(doc_id=kind_of(media), n_bytes="long", payload_bytes="long", payload_sha256="string", tail_crc32="long", media_bytes="long", media_sha256="string", feature="string")
    return map_frames(media.select("doc_id", "n_bytes", "media"), run, out)
