"""WARC (operator 10): a legacy ARC converter, a WARC writer and a WARC reader.

ARC: the first record (filedesc://) declares the version; version 1 header lines have 5 fields, version 2 lines 10. The
declared length, the last field, bounds each body, whatever it holds. Converted records get an identifier (a UUID
derived from archive name and offset, so reruns agree), an ISO timestamp from the 14-digit one, a type (filedesc:
warcinfo; http and https: response; all else: resource) and SHA-1 digests of block and payload. Records whose
payload another record holds are written as revisits: HTTP headers, the full payload's digest and length, and a reference.

The archives lie in the shared folder as gzip files that Spark's committers wrote; their number follows the input.

Defined results: null html is an empty payload; rows that share a page_id and a payload and are the largest are each a
response; rows with null page_id are never the one referred to unless no other has that payload (then all are
responses); a null url is written as urn:unknown, white space in one is percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import parts_for
from lattica.plans.rounds import cut, shared_dir

FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length")}
NAMESPACE = uuid.UUID("6c1a9f3e-52b6-4c55-9d5f-0f6d5c0a7e11")
CRLF = "\r\n"


@dataclass
class ArcRecord:
    header: dict
    body: bytes
    offset: int
    version: int


def arc_file(name: str, records: list[tuple[str, str, str, str, bytes]], version: int = 1) -> bytes:
    """An archive of (url, ip, 14-digit date, type, body) records."""
    about = f"{version} 0 lattica\n" + " ".join(FIELDS[version]) + "\n"
    out = b""
    for url, ip, date, kind, body in [("filedesc://" + name, "0.0.0.0", records[0][2] if records else "19700101000000", "text/plain", about.encode()), *records]:
        extra = f" 200 - - {len(out)} {name}" if version == 2 else ""
        out += f"{url} {ip} {date} {kind}{extra} {len(body)}\n".encode() + body + b"\n"
    return out


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, the filedesc record first."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        length = int(parts[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"record at {at} is cut short: {len(body)} of {length} bytes")
        if not version:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("no filedesc record")
            version = int(body.split(b" ", 1)[0])
        names = FIELDS[1 if len(parts) == 5 else 2]
        if len(parts) != len(names) or parts[0].startswith("filedesc://") < (len(parts) != len(FIELDS[version])):
            raise ValueError(f"version {version} header line at {at} has {len(parts)} fields")
        yield ArcRecord(dict(zip(names, parts, strict=True)), body, at, version)
        at = end + 1 + length


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive}#{offset}')}>"


def iso(date: str) -> str:
    d = (date + "0000")[:14] if len(date) < 14 else date
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, cut, payload = block.partition(b"\r\n\r\n")
    return (head + cut, payload) if cut and head.startswith(b"HTTP/") else (b"", block)


def to_warc(rec: ArcRecord, archive: str, refers_to: str | None = None) -> bytes:
    """The WARC record for an ARC record; with refers_to a revisit of that record."""
    url = rec.header["url"]
    kind = "warcinfo" if url.startswith("filedesc://") else "response" if url.startswith(("http://", "https://")) and rec.body.startswith(b"HTTP/") else "resource"
    head, payload = split_http(rec.body)
    digest = hashlib.sha1(payload).hexdigest()
    block = rec.body
    if refers_to and kind != "warcinfo":
        kind, block = "revisit", head
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(archive, rec.offset)}", f"WARC-Date: {iso(rec.header['date'])}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {archive}")
    else:
        lines += [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {rec.header['ip']}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    mime = "application/http; msgtype=response" if kind in ("response", "revisit") else "application/warc-fields" if kind == "warcinfo" else rec.header["type"]
    lines += [f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return (CRLF.join(lines) + CRLF * 2).encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record; gzip members are read through."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its length says")
        yield headers, block
        at = end + 8 + n


def page_archive(page_id: int | None, uid: int) -> str:
    return f"page-{page_id}.arc" if page_id is not None else f"row-{uid}.arc"


def first_offset(archive: str, version: int) -> int:
    """Where the record after filedesc begins in a one-page archive."""
    return len(arc_file(archive, [], version))


def page_arc(page_id: int | None, uid: int, url: str | None, html: str | None, date: str, version: int) -> tuple[str, bytes]:
    body = (html or "").encode()
    clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:unknown") or "urn:unknown"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(body)}\r\n\r\n"
    name = page_archive(page_id, uid)
    return name, arc_file(name, [(clean, "0.0.0.0", date, "text/html", head.encode() + body)], version)


def write_archives(pages: DataFrame, least: int = 1000, date: str = "20200101000000", version: int = 1) -> str:
    """Write one WARC record per row of pages (page_id, url, html) through ARC records; the folder's path."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.monotonically_increasing_id().alias("uid"))
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    lean = plain.select("page_id", F.sha1(raw).alias("digest"), F.length(raw).alias("size")).filter(F.col("size") >= least)
    heads = lean.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1 and head is not null")
    again = lean.join(heads.withColumnRenamed("digest", "h_digest"), F.col("digest") == F.col("h_digest")).filter("page_id is null or page_id <> head")
    parts = parts_for(plain, 16)
    key = F.concat_ws(":", F.col("page_id").cast("string"), "digest")  # rows that repeat a page and its payload share their fate
    again = again.select(key.alias("a_key"), "head").distinct().repartition(parts, "a_key")
    rows = plain.withColumn("digest", F.sha1(raw)).withColumn("key", key).repartition(parts, "key").join(again.hint("shuffle_hash"), F.col("key") == F.col("a_key"), "left")

    def run(batches):
        for pdf in batches:
            out = []
            for p, u, url, html, head in zip(pdf["page_id"], pdf["uid"], pdf["url"], pdf["html"], pdf["head"], strict=True):
                name, data = page_arc(None if pd.isna(p) else int(p), u, url, html, date, version)
                refers = None
                if not pd.isna(head):
                    other = page_archive(int(head), 0)
                    refers = record_id(other, first_offset(other, version))
                for rec in list(parse_arc(data))[1:]:
                    out.append(to_warc(rec, name, refers)[:-4].decode("utf-8"))
            yield pd.DataFrame({"value": out})

    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    done = rows.select("page_id", "uid", "url", "html", "head").mapInPandas(run, "value string")
    done.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
    return path


def read_archives(spark, path: str) -> DataFrame:
    """record_id, warc_type, target_uri, warc_date, page_id, payload_bytes, payload_digest, refers_to_id of every record."""

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                out = []
                for h, block in read_warc(bytes(data)) if len(data) else ():
                    head, payload = split_http(block)
                    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(CRLF)[1:])}
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    whole = h["warc-type"] != "revisit"
                    if hashlib.sha1(block).hexdigest() != h["warc-block-digest"].removeprefix("sha1:") or whole and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"digest of {h['warc-record-id']} differs")
                    out.append((h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h["warc-date"], int(http["x-page-id"]) if http.get("x-page-id") else None, len(payload) if whole else int(http["content-length"]), digest, h.get("warc-refers-to")))
                frame = pd.DataFrame(out, columns=["record_id", "warc_type", "target_uri", "warc_date", "page_id", "payload_bytes", "payload_digest", "refers_to_id"])
                yield frame.assign(page_id=pd.array(frame["page_id"], "Int64"))

    files = spark.read.format("binaryFile").load(path).filter("path like '%part-%'").select("content")
    return files.mapInPandas(run, "record_id string, warc_type string, target_uri string, warc_date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string")


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every row, as read back from the archives."""
    back = cut(read_archives(pages.sparkSession, write_archives(pages, least)), "records")  # archives are parsed once; payloads stay in them
    ids = back.filter("warc_type not in ('revisit', 'warcinfo')").groupBy(F.col("record_id").alias("r_id")).agg(F.max("page_id").alias("r_page"))
    plain = back.select("page_id", "payload_bytes", "payload_digest", F.when(F.col("warc_type") == "revisit", "revisit").otherwise("response").alias("record_type"), "refers_to_id")
    return plain.join(ids, F.col("refers_to_id") == F.col("r_id"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("r_page").alias("refers_to"))
