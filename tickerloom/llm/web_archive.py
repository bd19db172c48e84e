"""Legacy ARC archives and their conversion to WARC.

Archives are gzip files below a folder of any file system that Spark reads; a task writes one file and reads whole files,
byte after byte in order, so neither side holds more than one record and one Arrow batch. Files that Spark would split
(uncompressed ones above `spark.sql.files.maxPartitionBytes`) fail the job with that reason: records are only found by
the declared lengths from the start.

ARC: a version block, then records. A header line has the fields of its version, space-separated:

* 1: URL IP-address Archive-date Content-type Archive-length
* 2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The URL is what stands before the others, spaces and all; "-" is no value; blank lines between records are skipped. A line
without these fields, a length beyond the file or an unknown version fails the job.

Conversion (`convert`): identifiers are name-based UUIDs of the record's digest, URL, date and place (path of the archive,
number in it), the same whenever an archive is read again; 14-digit (or shorter) dates become ISO times; the type follows from the scheme and from repeats: of records with
equal payloads of at least `least_bytes` the one with the smallest page_id is the response (a record without one comes
last; of repeated rows the first by identifier), the others are revisits, which keep the HTTP headers and drop the
payload. `dns:` records become resources. Payload and block digests are SHA-1 in base 32.

Pages: null html is empty, a null url is "-" and comes back as such, line breaks in a url are percent-encoded, a null page_id comes back as null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.staging import Stages

#: Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = b"WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs
_RECORD = (
    "record_id string, page_id long, url string, ip string, date string, mime string, payload_bytes long, payload_digest string, block binary"
)
_WARC = (
    "record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string,"
    " refers_to_id string, digest_ok boolean, headers string, payload binary"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_time(date: str) -> str:
    """`2003`, `20030201` or `20030201123456` as an ISO time; parts that are absent are the earliest."""
    if not re.fullmatch(r"\d{4}(\d\d){0,5}", date):
        raise ValueError(f"not an archive date: {date!r}")
    parts = date + "00000101000000"[len(date) :]
    return f"{parts[:4]}-{parts[4:6]}-{parts[6:8]}T{parts[8:10]}:{parts[10:12]}:{parts[12:14]}Z"


# ---- bytes of archives ----


class _Bytes:
    """The bytes of one file, refilled from Arrow batches of its lines."""

    def __init__(self, chunks: Iterator[bytes], file: int = 0):
        self.chunks, self.file, self.held, self.at = chunks, file, b"", 0

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held, self.at = self.held[self.at :] + chunk, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None after the last."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                return None
        found = self.held[self.at : end]
        self.at = end + 1
        return found

    def take(self, n: int) -> bytes:
        parts, missing = [], n
        while len(self.held) - self.at < missing:
            parts.append(self.held[self.at :])
            missing -= len(parts[-1])
            self.at = len(self.held)
            if not self._more():
                raise ValueError(f"the archive ends {missing} bytes before a declared length")
        parts.append(self.held[self.at : self.at + missing])
        self.at += missing
        return b"".join(parts)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, begin, line`: lines in order; a task has whole files."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("line")
    )


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[_Bytes]:
    """The files of a task, one after the other. Each must be read to its end before the next."""
    waiting: list[tuple[int, bytes]] = []

    def parts() -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("begin").to_numpy().any():
                raise ValueError("an archive was split between tasks; compress it or raise spark.sql.files.maxPartitionBytes above its size")
            file = batch.column("file").to_numpy()
            cuts = [0, *(np.flatnonzero(file[1:] != file[:-1]) + 1).tolist(), len(file)]
            lines = batch.column("line").cast(pa.large_binary())
            for a, b in zip(cuts, cuts[1:]):
                yield int(file[a]), _with_ends(lines.slice(a, b - a))

    source = parts()

    def one(file: int, first: bytes) -> Iterator[bytes]:
        yield first
        for other, chunk in source:
            if other != file:
                waiting.append((other, chunk))
                return
            yield chunk

    while True:
        if not waiting:
            found = next(source, None)
            if found is None:
                return
            waiting.append(found)
        file, first = waiting.pop()
        yield _Bytes(one(file, first), file)


def _with_ends(lines: pa.Array) -> bytes:
    """The lines with their line ends, as they stand in the file."""
    bounds = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    held = lines.buffers()[2]
    out = np.full(bounds[-1] - bounds[0] + len(lines), 10, np.uint8)
    end = np.zeros(len(out), dtype=bool)
    end[bounds[1:] - bounds[0] + np.arange(len(lines))] = True
    if held is not None:
        out[~end] = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]]
    return out.tobytes()


def _text_batch(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])


def _write(rows: DataFrame, path: str, line_end: str) -> None:
    """Binary rows one after the other, each with `line_end`, in gzip files."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", line_end).option("compression", "gzip").option(
        "maxRecordsPerFile", 0
    ).text(path)


# ---- ARC ----


def _http_block(page_id: int | None, payload: bytes, mime: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n"
    if page_id is not None:
        head += f"X-Page-Id: {page_id}\r\n"
    return head.encode() + b"\r\n" + payload


def _version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tickerloom\n{ARC_FIELDS[version]}\n".encode()
    fields = {
        1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}",
        2: f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}",
    }
    return fields[version].encode() + b"\n" + body


def write_arc(
    pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), date: str = "20240101000000", ip: str = "0.0.0.0", mime: str = "text/html"
) -> None:
    """`page_id, url, html` as ARC files, one a task; tasks take the versions in turn. The page_id is a header of the response."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = versions[part % len(versions)], f"pages-{part:05d}.arc"
        block = _version_block(version, name, date)
        offset = len(block) + 1
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                content = _http_block(page_id, html or b"", mime)
                link = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"
                middle = "" if version == 1 else f" 200 {sha1_base32(content)} - {offset} {name}"
                record = f"{link} {ip} {date} {mime}{middle} {len(content)}".encode() + b"\n" + content
                offset += len(record) + 1
                out.append(block + b"\n" + record if block else record)
                block = b""
            if out:
                yield _text_batch(out)

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html"))
    _write(source.mapInArrow(written, "value binary"), path, "\n")


def _arc_records(stream: _Bytes) -> Iterator[tuple[list[str], bytes, int]]:
    """(URL, IP, date, type and the version's other fields; content; number in the file) of each record after the version block."""
    first = stream.line()
    if first is None:
        return
    if not first.startswith(b"filedesc://"):
        raise ValueError(f"no version block: {first[:80]!r}")
    body = stream.take(int(first.rpartition(b" ")[2]))
    version = int(body.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    others = len(ARC_FIELDS[version].split()) - 1
    number = 0
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        fields = line.rstrip(b"\r").decode(errors="surrogateescape").rsplit(" ", others)
        if len(fields) != others + 1 or not fields[-1].isdigit():
            raise ValueError(f"not a header line of version {version}: {line[:200]!r}")
        number += 1
        yield fields, stream.take(int(fields[-1])), number


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """Status line and headers with the empty line, and the payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def _header_number(head: bytes, name: bytes) -> int | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*(-?\d+)[ \t]*\r?$", head)
    return int(found[1]) if found else None


def read_arc(spark: SparkSession, path: str, with_blocks: bool = True) -> DataFrame:
    """`record_id, page_id, url, ip, date, mime, payload_bytes, payload_digest, block`: one row per record of the folder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in _files(batches):
            held, size = [], 0
            for (url, ip, date, mime, *_), block, number in _arc_records(stream):
                head, payload = _split_http(block)
                page_id, digest, time = _header_number(head, b"X-Page-Id"), sha1_base32(payload), iso_time(date)
                name = uuid.uuid5(_NAMES, f"{digest} {page_id} {time} {stream.file} {number} {url.encode(errors='surrogateescape').hex()}")
                clean = url.encode(errors="surrogateescape").decode(errors="replace")
                held.append((f"<urn:uuid:{name}>", page_id, clean, ip, time, mime, len(payload), digest, block if with_blocks else None))
                size += len(block)
                if size > 4 << 20:
                    yield _rows_batch(held)
                    held, size = [], 0
            if held:
                yield _rows_batch(held)

    return _lines(spark, path).mapInArrow(rows, _RECORD)


_RECORD_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
_WARC_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.binary()]


def _rows_batch(rows: list[tuple], kinds: list | None = None, schema: str = _RECORD) -> pa.RecordBatch:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds or _RECORD_KINDS)], names=names)


# ---- conversion ----


def first_of_equals(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`record_id` of every record that revisits another, and `first_id, first_url, first_date` of that one."""
    seen = records.where(F.col("payload_bytes") >= least_bytes).select("record_id", "page_id", "url", "date", "payload_digest", "payload_bytes")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("record_id").alias("id"), "url", "date")
    first = seen.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"))
    return (
        seen.select("record_id", "payload_digest", "payload_bytes").join(first, ["payload_digest", "payload_bytes"])
        .where(F.col("record_id") != F.col("first.id"))
        .select("record_id", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date"))
    )


def _warc_record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return WARC_VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n"


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    info = None
    for batch in batches:
        out, size = [], 0
        for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            if info is None:
                body = b"software: tickerloom\r\nformat: WARC File Format 1.0\r\nconformsTo: ARC converted\r\n"
                info = _warc_record("warcinfo", {
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMES, 'info ' + r['record_id'])}>", "WARC-Date": r["date"], "Content-Type": "application/warc-fields",
                }, body)
                out.append(info)
            head, payload = _split_http(r["block"])
            http, revisit = bool(head), r["first_id"] is not None
            kind = "revisit" if revisit else "response" if http else "resource"
            block = head if revisit else r["block"]
            out.append(_warc_record(kind, {
                "WARC-Record-ID": r["record_id"], "WARC-Date": r["date"], "WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"],
                "Content-Type": "application/http; msgtype=response" if http else r["mime"],
                "WARC-Payload-Digest": f"sha1:{r['payload_digest']}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
                "WARC-Refers-To": r["first_id"], "WARC-Refers-To-Target-URI": r["first_url"], "WARC-Refers-To-Date": r["first_date"],
                "WARC-Profile": REVISIT_PROFILE if revisit else None,
            }, block))
            size += len(block)
            if size > 4 << 20:
                yield _text_batch(out)
                out, size = [], 0
        if out:
            yield _text_batch(out)


def convert(spark: SparkSession, arc: str, warc: str, least_bytes: int = 0) -> None:
    """Every record of the ARC folder as a WARC record. Headers and digests decide first, in a written table of the repeats:
    where its size allows, Spark sends it to the archives; else blocks are shuffled once, by identifier, so a payload
    held by very many records is no group."""
    stages = Stages(spark, "archive-repeats")
    decided = stages.put(first_of_equals(read_arc(spark, arc, with_blocks=False), least_bytes))
    rows = read_arc(spark, arc).join(decided, "record_id", "left")
    _write(rows.mapInArrow(_warc_rows, "value binary"), warc, "\r\n")
    stages.drop(decided)


# ---- WARC ----


def _warc_records(stream: _Bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields: dict[str, str] = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode(errors="replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.take(int(fields["content-length"]))


def read_warc(spark: SparkSession, path: str, with_payloads: bool = True) -> DataFrame:
    """One row per record other than warcinfo. Of a revisit, size and digest of the payload are the declared ones; `digest_ok`
    says whether block and payload that are there have their declared digests."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in _files(batches):
            held, size = [], 0
            for f, block in _warc_records(stream):
                kind = f.get("warc-type")
                if kind == "warcinfo":
                    continue
                head, payload = _split_http(block)
                declared = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                ok = f.get("warc-block-digest") in (None, f"sha1:{sha1_base32(block)}")
                if kind == "revisit":
                    n, digest = _header_number(head, b"Content-Length"), declared
                else:
                    n, digest = len(payload), sha1_base32(payload)
                    ok = ok and declared in (None, digest)
                held.append((
                    f["warc-record-id"], kind, f.get("warc-target-uri"), f.get("warc-date"), _header_number(head, b"X-Page-Id"), n, digest,
                    f.get("warc-refers-to"), ok, head.decode(errors="replace"), payload if with_payloads else None,
                ))
                size += len(block)
                if size > 4 << 20:
                    yield _rows_batch(held, _WARC_KINDS, _WARC)
                    held, size = [], 0
            if held:
                yield _rows_batch(held, _WARC_KINDS, _WARC)

    return _lines(spark, path).mapInArrow(rows, _WARC)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to, digest_ok."""
    spark = pages.sparkSession
    stages = Stages(spark, "web-archive")
    arc, warc = f"{stages.root}/arc", f"{stages.root}/warc"
    write_arc(pages, arc)
    if not _holds_files(spark, arc):
        return read_nothing(spark)
    convert(spark, arc, warc, least_bytes)
    stages.drop_path(arc)
    records = stages.put(read_warc(spark, warc, with_payloads=False).drop("headers", "payload"))
    stages.drop_path(warc)
    first = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    again = records.where("record_type = 'revisit'").join(first, "refers_to_id", "left")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"]
    return again.select(columns).unionByName(records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(columns))


def read_nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"
    )


def _holds_files(spark: SparkSession, path: str) -> bool:
    """Whether there is an archive: of no pages there is none."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/*.gz")
    listed = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    return listed is not None and len(listed) > 0
