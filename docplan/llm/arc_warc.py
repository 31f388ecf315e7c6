"""Legacy archive converter: ARC files of either version to WARC.

An ARC file starts with a version block (`filedesc://`) whose body tells the version and the names of the header's fields; each record
is a header line with those fields, the last being the declared length, and so many bytes of content. The converter parses the lines by
the version's fields, takes exactly the declared lengths, and makes for each record the WARC identifier, timestamp, type and digests
that a WARC writer would have given it.

Null payloads are empty. Null addresses become `unknown:`, white space in addresses is percent-encoded, for ARC's fields are parted by
blanks. A null page_id stays null. Repeated rows are archived each; those with the largest page_id of equal payloads are all responses.
An empty table gives no archives. Very long payloads make an archive of their own. Other columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, rows_of, stored, struct

#: Payloads from this many bytes on are archived once.
REVISIT_FROM = 1000
#: Bytes of records of an archive; an archive is one row, and at least one record.
ARCHIVE = 4_000_000

# The header fields of ARC versions 1 and 2, and the WARC profile of revisits.
FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"], 2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Captured(NamedTuple):
    """An ARC record: fields of its header line by name, and its content."""

    fields: dict[str, str]
    content: bytes


class Record(NamedTuple):
    """A WARC record: its headers by lower-case name, and its block."""

    headers: dict[str, str]
    block: bytes


# ---- ARC


def arc_open(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 docplan\n{' '.join(FIELDS[version])}\n".encode()
    extra = {1: "", 2: f"200 - - 0 {name} "}[version]
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body) + 1}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, kind: str, content: bytes, code: int = 200, name: str = "-", offset: int = 0) -> bytes:
    extra = {1: "", 2: f"{code} {hashlib.md5(content).hexdigest()} - {offset} {name} "}[version]
    return f"{url} {ip} {date} {kind} {extra}{len(content)}\n".encode("utf-8", "surrogatepass") + content + b"\n"


def arc_parse(data: bytes) -> Iterator[Captured]:
    """All records, the version block first. Its second line names the fields; without one, they are those of its version."""
    at, names = 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        stop = data.index(b"\n", at)
        line = data[at:stop].decode("utf-8", "surrogatepass")
        parts = line.split(" ")
        if line.startswith("filedesc://"):
            body = data[stop + 1 : stop + 1 + int(parts[-1])]
            head = body.decode("utf-8", "replace").splitlines()
            version = int(head[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} isn't known")
            names = head[1].split(" ") if len(head) > 1 and head[1].startswith("URL") else FIELDS[version]
            fields = dict(zip(FIELDS[2] if len(parts) == len(FIELDS[2]) else FIELDS[1], parts, strict=True))
        else:
            if len(parts) != len(names):
                raise ValueError(f"a header line has {len(parts)} fields, its version {len(names)}: {line[:200]}")
            fields = dict(zip(names, parts, strict=True))
        size = int(fields["Archive-length"])
        content = data[stop + 1 : stop + 1 + size]
        if len(content) != size:
            raise ValueError("the file ends inside a record")
        yield Captured(fields, content)
        at = stop + 1 + size


# ---- WARC


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def instant(date: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC date; what is missing is the earliest."""
    d = (re.sub(r"\D", "", date) + "00000101000000"[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def identifier(*parts: str) -> str:
    """The same for the same record, so that a task that runs again writes the same archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def http_split(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; no header where the content doesn't start with one."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    cut = content.find(b"\r\n\r\n")
    return (content, b"") if cut < 0 else (content[: cut + 4], content[cut + 4 :])


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", digest32(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def convert(record: Captured, version: int, refers_to: tuple[str, str, str] | None = None, extra: Iterable[tuple[str, str]] = ()) -> bytes:
    """A WARC record for an ARC record: warcinfo for a version block, response for HTTP, resource for all else, and revisit with only
    the HTTP header where refers_to gives identifier, address and date of the record with an equal payload."""
    f = record.fields
    url, date = f["URL"], instant(f["Archive-date"])
    if url.startswith("filedesc://"):
        body = f"software: docplan\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC/{version}\r\n".encode()
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", identifier(url, date)), ("WARC-Date", date), ("WARC-Filename", url[11:]), ("Content-Type", "application/warc-fields")], body)
    head, payload = http_split(record.content)
    kind = "revisit" if refers_to else "response" if head else "resource"
    digest = digest32(payload)
    found = [("WARC-Type", kind), ("WARC-Record-ID", identifier(url, date, digest, *(v for _, v in extra))), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", f["IP-address"]), ("WARC-Payload-Digest", digest)]
    if refers_to:
        found += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to[0]), ("WARC-Refers-To-Target-URI", refers_to[1]), ("WARC-Refers-To-Date", refers_to[2]), ("WARC-Truncated", "length")]
    found += [("Content-Type", "application/http; msgtype=response" if head else f["Content-type"]), *extra]
    return warc_record(found, head if refers_to else record.content)


def warc_parse(data: bytes) -> Iterator[Record]:
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(headers["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size or digest32(block) != headers["warc-block-digest"]:
            raise ValueError(f"the record {headers.get('warc-record-id')} is damaged")
        yield Record(headers, block)
        at = stop + 4 + size + 4


# ---- tables


def address(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f\x85\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "unknown:") or "unknown:"


def source(page_id: object) -> tuple[str, str, int]:
    """Address, date and ARC version that the table's pages, which have none, are given by their number."""
    n = 0 if page_id is None or pd.isna(page_id) else int(page_id) % 86_400
    return f"10.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}", f"20010101{n // 3600:02d}{n // 60 % 60:02d}{n % 60:02d}", 1 + n % 2


def capture(html: bytes) -> bytes:
    return b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(html)).encode() + b"\r\n\r\n" + html


def originals(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """pages with digest and origin: for payloads of least bytes that occur again, the largest page_id that has them. Counted with
    partial aggregation; the join is by digest, and Spark splits a hot one."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    t = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    t = t.withColumn("digest", F.unhex(F.sha2("html", 256)))
    again = t.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("origin"), F.max_by("url", F.struct(F.coalesce("page_id", F.lit(-(2**63))), "url")).alias("origin_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    return t.join(again, "digest", "left")


def archives(pages: DataFrame, least: int = REVISIT_FROM, size: int = ARCHIVE) -> DataFrame:
    """(archive, records, warc): the pages as ARC records of both versions, converted to WARC; each row is a whole archive."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {1: [], 2: []}
        held_size = {1: 0, 2: 0}

        def close(version: int) -> Iterator[pd.DataFrame]:
            rows, held[version], held_size[version] = held[version], [], 0
            if not rows:
                return
            name = f"pages-v{version}-{uuid.uuid5(uuid.NAMESPACE_OID, repr([r[0] for r in rows])).hex}.arc"
            _, date, _ = source(rows[0][0])
            arc = [arc_open(version, name, date)]
            at = len(arc[0])
            for page, url, html, _, _ in rows:
                ip, date, _ = source(page)
                arc.append(arc_record(version, address(url), ip, date, "text/html", capture(html), name=name, offset=at))
                at += len(arc[-1])
            out, told = [], iter([None, *rows])
            for record in arc_parse(b"".join(arc)):
                row, refers, extra = next(told), None, []
                if row is not None:
                    page, _, html, origin, origin_url = row
                    extra = [("X-Page-Id", "" if page is None else str(page)), ("X-Payload-Length", str(len(html)))]
                    if origin is not None and origin != page:
                        when = instant(source(origin)[1])
                        refers = (identifier(address(origin_url), when, digest32(html), str(origin), str(len(html))), address(origin_url), when)
                out.append(convert(record, version, refers, extra))
            yield pd.DataFrame({"archive": [name[:-3] + "warc"], "records": [len(rows)], "warc": [b"".join(out)]})

        for x in batches:
            for page, url, html, origin, origin_url in zip(*(x[c] for c in ("page_id", "url", "html", "origin", "origin_url")), strict=True):
                page = None if pd.isna(page) else int(page)
                version = source(page)[2]
                held[version].append((page, url, bytes(html), None if pd.isna(origin) else int(origin), origin_url))
                held_size[version] += len(html) + 500
                if held_size[version] >= size:
                    yield from close(version)
        yield from close(1)
        yield from close(2)

    return map_frames(originals(pages, least).drop("digest"), run, struct(archive="string", records="long", warc="binary"))


def read_records(warcs: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to_id and the identifiers of the records in a column of archives. A
    response's size and digest come from its block; a revisit has them from its headers."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for warc in x["warc"]:
                for r in warc_parse(bytes(warc)):
                    h = r.headers
                    if h["warc-type"] == "warcinfo":
                        continue
                    digest = base64.b32decode(h["warc-payload-digest"][5:]).hex()
                    n = int(h["x-payload-length"])
                    if h["warc-type"] != "revisit":
                        payload = http_split(r.block)[1]
                        n, found = len(payload), hashlib.sha1(payload).hexdigest()
                        if found != digest:
                            raise ValueError(f"the payload of {h['warc-record-id']} is damaged")
                    rows.append((int(h["x-page-id"]) if h["x-page-id"] else None, n, digest, h["warc-type"], h.get("warc-refers-to"), h["warc-record-id"], h["warc-date"]))
            yield rows_of(rows, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id", "record_id", "warc_date"])

    return map_frames(warcs.select("warc"), run, struct(page_id="long", payload_bytes="long", payload_digest="string", record_type="string", refers_to_id="string", record_id="string", warc_date="string"))


def read_pages(warcs: DataFrame) -> DataFrame:
    """read_records() with refers_to: the page_id of the record that a revisit names in WARC-Refers-To, null where no archive has it. Of
    the other records only those that are named are joined, and each once, however often its row was archived."""
    records = stored(read_records(warcs), "records")
    named = records.where("refers_to_id IS NOT NULL").select(F.col("refers_to_id").alias("record_id")).distinct()
    target = records.where("record_type <> 'revisit'").select("record_id", "page_id").join(named, "record_id", "left_semi").dropDuplicates(["record_id"])
    revisits = records.where("record_type = 'revisit'").join(target.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")), "refers_to_id", "left")
    rest = records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return rest.unionByName(revisits)


def round_trip(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    return read_pages(stored(archives(pages, least), "warc"))
