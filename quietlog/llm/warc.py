"""Web pages to WARC archives by way of the legacy ARC format, and back.

An ARC archive starts with a version block (`filedesc://`) whose second line tells the version, and so which fields the
header line of each record has; the last field declares the record's length. `convert_arc` reads both versions and
makes what a WARC record needs beyond that: record id, ISO timestamp, record type and digests.

Nulls and odd input: a null html is an empty payload, a null url is written as an empty one, a null page_id stays null
and never is what others refer to, unless all copies have none. Repeated rows with the smallest page_id of their
payload are all responses. An empty table gives empty archives and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.session import scratch

#: fixed values: field names of the header lines, by ARC version
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: bytes of records after which an archive is closed
ARCHIVE_BYTES = 16 << 20

ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string"


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    status: int | None
    content: bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC ---------------------------------------------------------------------------------------------------------


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 quietlog\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain",
              "Result-code": "200", "Filename": name}
    return _arc_line(version, values, len(body)) + body + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes, name: str = "-", offset: int = 0) -> bytes:
    """A document record: header line, content, newline."""
    values = {"URL": quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") or "-", "IP-address": "0.0.0.0", "Archive-date": date,
              "Content-type": "text/html", "Result-code": "200", "Checksum": digest(content), "Offset": str(offset),
              "Filename": name}
    return _arc_line(version, values, len(content)) + content + b"\n"


def _arc_line(version: int, values: dict[str, str], length: int) -> bytes:
    values = values | {"Archive-length": str(length)}
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version]) + "\n").encode()


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The document records of an archive of either version; a broken header line or length is an error."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # records are set apart by empty lines
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:end].decode() if end >= 0 else ""
        values = line.split(" ")
        if not version:
            head = data[end + 1 : data.find(b"\n", end + 1)].decode(errors="replace").split(" ")
            if not line.startswith("filedesc://") or head[0] not in ("1", "2"):
                raise ValueError(f"no ARC version block: {line[:80]!r}")
            version = int(head[0])
        if len(values) != len(ARC_FIELDS[version]) or not values[-1].isdigit() or end + 1 + int(values[-1]) > len(data):
            raise ValueError(f"broken ARC header line at byte {at}: {line[:80]!r}")
        field = dict(zip(ARC_FIELDS[version], values, strict=True))
        content = data[end + 1 : end + 1 + int(values[-1])]
        at = end + 1 + len(content)
        if not field["URL"].startswith("filedesc://"):
            status = field.get("Result-code", "")
            url = "" if field["URL"] == "-" else field["URL"]
            yield ArcRecord(url, field["IP-address"], field["Archive-date"], field["Content-type"], int(status) if status.isdigit() else None, content)


# --- WARC --------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None, payload_digest: str) -> str:
    """UUID of version 8: the page id, then bits of the payload's digest; the same page always gets the same."""
    raw = (((page_id or 0) & (1 << 64) - 1) << 58) | (int.from_bytes(base64.b32decode(payload_digest)[:8], "big") >> 6)
    high, middle, low = raw >> 74, raw >> 62 & 0xFFF, raw & (1 << 62) - 1
    return str(uuid.UUID(int=high << 80 | 8 << 76 | middle << 64 | 2 << 62 | low))


def page_of(record: str) -> int:
    """The page id in a `record_id`."""
    n = uuid.UUID(record).int
    raw = (n >> 80) << 74 | (n >> 64 & 0xFFF) << 62 | n & (1 << 62) - 1
    page = raw >> 58
    return page - (1 << 64) if page >> 63 else page


def convert_arc(data: bytes, first: list[int | None]) -> Iterator[bytes]:
    """WARC records of an ARC archive. first: for each record the page that it revisits, or None."""
    for record, target in zip(read_arc(data), first, strict=True):
        head, _, payload = record.content.partition(b"\r\n\r\n")
        page = re.search(rb"^X-Page-Id: (-?\d+)\r?$", head, re.M)
        known = digest(payload)
        t = record.date
        fields = [
            ("WARC-Type", "response" if target is None else "revisit"),
            ("WARC-Record-ID", f"<urn:uuid:{record_id(int(page[1]) if page else None, known)}>"),
            ("WARC-Date", f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z"),
            ("WARC-Target-URI", record.url),
            ("WARC-IP-Address", record.ip),
            ("WARC-Payload-Digest", f"sha1:{known}"),
        ]
        block = record.content
        if target is not None:
            fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:uuid:{record_id(target, known)}>"), ("WARC-Truncated", "length")]
            block = head + b"\r\n\r\n"
        fields += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
        yield b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"broken WARC record at byte {at}")
        yield fields, data[end + 4 : stop]
        at = stop + 4


# --- Spark -------------------------------------------------------------------------------------------------------


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, html and `first`: for pages whose payload a smaller page_id has, that page.

    Payloads are compared by digest. The groups are summed up before they are shuffled, and the join back is one that
    Spark can split where a payload is very common.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    least = rows.groupBy("sha").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null")
    first = F.when(F.col("page_id").eqNullSafe(F.col("least")), None).otherwise(F.col("least"))
    return rows.join(least, "sha", "left").select("page_id", "url", "html", first.alias("first"))


def archives(pages: DataFrame, date: str = "20240101000000", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages (with `first`) as WARC archives of about `archive_bytes`, one per row, each made from an ARC archive.

    The last record's closing empty lines are left to the writer.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, parts, first, size = 0, [], [], 0

        def close() -> pa.RecordBatch:
            warc = b"\r\n\r\n".join(convert_arc(b"".join(parts), first))
            return pa.record_batch({"archive": pa.array([warc], pa.binary())})

        for batch in batches:
            for page, url, html, target in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                version, name = 1 + made % 2, f"pages-{made}.arc"
                if not parts:
                    parts.append(arc_head(version, name, date))
                payload = html.encode()
                mark = b"" if page is None else b"X-Page-Id: %d\r\n" % page
                content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (mark, len(payload)) + payload
                parts.append(arc_record(version, url, date, content, name, size))
                first.append(target)
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield close()
                    made, parts, first, size = made + 1, [], [], 0
        if first:
            yield close()

    return pages.mapInArrow(build, "archive binary")


def write_archives(warc: DataFrame, path: str) -> None:
    """One gzip file per archive; the line separator closes the last record."""
    lines = warc.select(F.col("archive").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record. Digest and length of a response are taken from its payload, and must be the declared ones."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows = [row(*x) for x in read_warc(gzip.decompress(blob.as_buffer()))]
                if rows:
                    names = [x.split()[0] for x in ROWS.split(", ")]
                    kinds = [pa.string() if "string" in x else pa.int64() for x in ROWS.split(", ")]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def row(fields: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        page = re.search(rb"^X-Page-Id: (-?\d+)\r?$", head, re.M)
        size = int(re.search(rb"^Content-Length: (\d+)\r?$", head, re.M)[1])
        known = fields["warc-payload-digest"].removeprefix("sha1:")
        target = fields.get("warc-refers-to")
        if target is None and (digest(payload), len(payload)) != (known, size):
            raise ValueError(f"payload and digest differ in {fields['warc-record-id']}")
        refers = page_of(target.removeprefix("<urn:uuid:").rstrip(">")) if target else None
        return int(page[1]) if page else None, size, known, fields["warc-type"], refers, fields.get("warc-target-uri", ""), fields["warc-date"]

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(parse, ROWS)


def convert_pages(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder, and read them back."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(archives(with_first(pages)), path)
    return read_archives(pages.sparkSession, path)
