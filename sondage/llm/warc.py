"""Archives: ARC writing and parsing, conversion of ARC to WARC, WARC reading.

ARC files of version 1 and 2 differ in the fields of a record's header line;
the version block at the head of a file says which it is. Records are cut by
their declared lengths. A converted record gets a deterministic identifier, an
ISO timestamp, a type and a SHA-256 payload digest; of records with equal
payloads of at least MIN_REVISIT bytes the one with the smallest source id is a
response and the others are revisits of it, without payload.

Archive files are rows (archive STRING, content BINARY), so that they can be
written and read wherever Spark can write and read; read_files() takes files.

Null payloads count as empty, null URLs as about:blank. Rows without a source id
are responses unless a row with one has the same payload; rows that repeat the
smallest source id are all responses. An empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Payloads below this many bytes are never revisits; bytes of an archive file before the next begins.
MIN_REVISIT, ARCHIVE_BYTES = 100, 4 << 20
#: Up to this many repeated payloads are broadcast (about 60 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 100_000

#: The field lists of the two versions' header lines.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
SOURCE_HEADER = "X-Source-Id"

ARCHIVES = "archive string, content binary"
RECORDS = "archive string, offset long, url string, ip string, date string, mime string, status int, source_id long, head binary, payload binary"
READ = "archive string, offset long, record_id string, record_type string, url string, date string, source_id long, payload_digest string, payload_bytes long, refers_to_id string, refers_to long, payload binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [pa.field(*(lambda n, k: (n, kinds[k]))(*x.split())) for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        names = b.schema.names
        for row in zip(*(b.column(i) for i in range(len(names))), strict=True):
            yield {n: x.as_py() for n, x in zip(names, row, strict=True)}


def write_arc(pages: DataFrame, source_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000") -> DataFrame:
    """ARC files of pages; versions 1 and 2 take turns. The source id travels in the HTTP header."""

    def head(name: str, version: int) -> bytes:
        body = f"{version} 0 sondage\n{' '.join(ARC_FIELDS[version])}\n".encode()
        more = f"200 - - 0 {name} " if version == 2 else ""
        return f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(body)}\n".encode() + body + b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, out = TaskContext.get().partitionId(), 0, bytearray()
        name = ""
        for row in _cells(batches):
            version = 1 + (task + seq) % 2
            if not out:
                name = f"arc-{task:06d}-{seq:06d}.arc"
                out += head(name, version)
            payload = (row["html"] or "").encode()
            own = "" if row["id"] is None else f"{SOURCE_HEADER}: {row['id']}\r\n"
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
            place = quote(row["url"] or "about:blank", safe="!#$%&'()*+,/:;=?@[]~-._")
            more = f"200 - - {len(out)} {name} " if version == 2 else ""
            out += f"{place} 0.0.0.0 {date} text/html {more}{len(block)}\n".encode() + block + b"\n"
            if len(out) >= ARCHIVE_BYTES:
                yield _rows(ARCHIVES, [(name, bytes(out))])
                seq, out = seq + 1, bytearray()
        if out:
            yield _rows(ARCHIVES, [(name, bytes(out))])

    return pages.select(F.col(source_id).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, ARCHIVES)


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file, the version block left out. ValueError if a header line or length is wrong."""
    fields, at = None, 0
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at {at}")
        line = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is None:
            length = int(line[-1])
            version, *_ = content[end + 1 :].split(b" ", 1)
            fields = ARC_FIELDS.get(int(version))
            if not line[0].startswith("filedesc:") or fields is None:
                raise ValueError("no version block of a known version")
            at = end + 1 + length
            continue
        if len(line) != len(fields):
            raise ValueError(f"{len(line)} header fields at {at}; this version has {len(fields)}")
        own = dict(zip(fields, line, strict=True))
        length = int(own["Archive-length"])
        block = content[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"the record at {at} is cut short")
        head, payload = (block[: i + 4], block[i + 4 :]) if block.startswith(b"HTTP/") and (i := block.find(b"\r\n\r\n")) >= 0 else (b"", block)
        source = re.search(rb"(?im)^" + SOURCE_HEADER.encode() + rb": (-?\d+)\r?$", head)
        status = own.get("Result-code") or (m[1].decode() if (m := re.match(rb"HTTP/\S+ (\d+)", head)) else None)
        yield {
            "offset": at, "url": own["URL"], "ip": own["IP-address"], "date": own["Archive-date"], "mime": own["Content-type"],
            "status": int(status) if status and status.isdigit() else None, "source_id": int(source[1]) if source else None, "head": head, "payload": payload,
        }
        at = end + 1 + length


def read_arc(archives: DataFrame) -> DataFrame:
    """The records of ARC files given as rows."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _cells(batches):
            rows, size = [], 0
            for r in parse_arc(row["content"]):
                rows.append(tuple(({"archive": row["archive"]} | r)[n] for n in names))
                size += len(r["payload"])
                if size >= ARCHIVE_BYTES:
                    yield _rows(RECORDS, rows)
                    rows, size = [], 0
            yield _rows(RECORDS, rows)

    return archives.select("archive", "content").mapInArrow(run, RECORDS)


def decide(records: DataFrame) -> DataFrame:
    """records with payload_digest, payload_bytes, record_type and refers_to (the source id of the response)."""
    digested = records.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    repeated = (
        digested.where(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy("payload_digest")
        .agg(F.min("source_id").alias("_first"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("_first").isNotNull())
        .drop("_n")
    )
    repeated = materialise(repeated, "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = digested.join(repeated, "payload_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("source_id").eqNullSafe(F.col("_first"))
    plain = F.when(F.length("head") > 0, "response").otherwise("resource")
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise(plain)).withColumn("refers_to", F.when(again, F.col("_first"))).drop("_first")


def record_id(source_id: int | None, digest: str, place: str) -> str:
    """A name-based identifier; records without a source id are named by their place in the ARC files."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place if source_id is None else source_id}:{digest}')}"


def iso(date: str) -> str:
    d = (re.sub(r"\D", "", date) + "00000101000000"[len(date) :])[:14] if len(date) < 14 else date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def write_warc(decided: DataFrame) -> DataFrame:
    """WARC 1.1 files of the rows of decide()."""

    def head(name: str) -> bytes:
        body = b"software: sondage\r\nformat: WARC File Format 1.1\r\n"
        return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(None, '', name)}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)

    def record(r: dict) -> bytes:
        kind, digest = r["record_type"], r["payload_digest"]
        lines = [
            ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(r['source_id'], digest, f'{r["archive"]}:{r["offset"]}')}>"),
            ("WARC-Date", iso(r["date"])), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-X-Payload-Length", str(r["payload_bytes"])),
        ]
        if r["source_id"] is not None:
            lines.append(("WARC-X-Source-Id", str(r["source_id"])))
        if kind == "revisit":
            lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(r['refers_to'], digest, '')}>"), ("WARC-X-Refers-To-Source-Id", str(r["refers_to"]))]
        block = r["head"] + (b"" if kind == "revisit" else r["payload"])
        return _record([*lines, ("Content-Type", "application/http; msgtype=response" if r["head"] else r["mime"]), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, out = TaskContext.get().partitionId(), 0, bytearray()
        for row in _cells(batches):
            name = f"warc-{task:06d}-{seq:06d}.warc"
            out += (b"" if out else head(name)) + record(row)
            if len(out) >= ARCHIVE_BYTES:
                yield _rows(ARCHIVES, [(name, bytes(out))])
                seq, out = seq + 1, bytearray()
        if out:
            yield _rows(ARCHIVES, [(name, bytes(out))])

    names = [x.split()[0] for x in RECORDS.split(", ")]
    return decided.select(*names, "payload_digest", "payload_bytes", "record_type", "refers_to").mapInArrow(run, ARCHIVES)


def _record(lines: list[tuple[str, str]], block: bytes) -> bytes:
    text = "".join(f"{k}: {v}\r\n" for k, v in [*lines, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{text}\r\n".encode() + block + b"\r\n\r\n"


def parse_warc(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields by lower-case name, block) of each record. ValueError if one is damaged."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no record at {at}")
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in content[at:end].decode().split("\r\n")[1:]))
        start = end + 4
        stop = start + int(fields["content-length"])
        block = content[start:stop]
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        if fields.get("warc-block-digest", "") not in ("", f"sha256:{hashlib.sha256(block).hexdigest()}"):
            raise ValueError(f"the block at {at} doesn't have its digest")
        yield at, fields, block
        at = stop + 4


def read_warc(archives: DataFrame) -> DataFrame:
    """The records of WARC files given as rows (archive, content), warcinfo left out."""

    def of(archive: str, at: int, f: dict[str, str], block: bytes) -> tuple:
        kind = f["warc-type"]
        i = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -4
        payload = None if kind == "revisit" else block[i + 4 :]
        number = lambda k: int(f[k]) if k in f else None
        size = number("warc-x-payload-length")
        return (
            archive, at, f["warc-record-id"].strip("<>"), kind, f.get("warc-target-uri"), f.get("warc-date"), number("warc-x-source-id"),
            f.get("warc-payload-digest", "").rpartition(":")[2] or None if payload is None else hashlib.sha256(payload).hexdigest(),
            size if payload is None else len(payload), f.get("warc-refers-to", "").strip("<>") or None, number("warc-x-refers-to-source-id"), payload,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _cells(batches):
            rows, size = [], 0
            for at, f, block in parse_warc(row["content"]):
                if f["warc-type"] != "warcinfo":
                    rows.append(of(row["archive"], at, f, block))
                    size += len(block)
                if size >= ARCHIVE_BYTES:
                    yield _rows(READ, rows)
                    rows, size = [], 0
            yield _rows(READ, rows)

    return archives.select("archive", "content").mapInArrow(run, READ)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files of a folder as rows for read_arc() or read_warc()."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def convert(archives: DataFrame) -> DataFrame:
    """WARC files with the records of ARC files."""
    return write_warc(decide(read_arc(archives)))
