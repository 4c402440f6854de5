"""Legacy archive converter: ARC records to WARC records, and back to rows.

An ARC file opens with a version block whose third line names the fields of all header
lines: five in version 1, ten in version 2. A record is a header line, as many bytes as
its last field declares, and a line end. A WARC record gets an identifier, an ISO
timestamp, a type and digests from that. Every WARC record is a gzip member of its own, and
content may be any bytes.

Archives are written by Spark's text writer, so they go to any store it can write to: a row
is a run of members, and ends with an empty member but for its last byte, a zero, which is
the row separator that the writer is given. Files are rolled after a few such rows, and are
read member by member.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.filters import key_filter, may_hold
from stratavox.llm.store import batchwise, fresh_path, materialize, table, tidy_shuffles

# Fixed by the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Least payload in bytes for which an equal earlier payload is referred to.
REVISIT_FROM = 100
#: Date of records whose source gives none.
NO_DATE = "19700101000000"
#: Pages of an ARC chunk, and its bytes from which on it ends; chunks alternate between the versions.
CHUNK_PAGES, CHUNK_BYTES = 64, 4 << 20
#: Bytes from which on a run of members ends, and runs in a file: a file has about 128 MB, besides its largest records.
RUN_BYTES, FILE_RUNS = 16 << 20, 8
#: Payloads that have copies, up to which they are sent to every executor; with more, pages that may have one are joined by digest.
MAX_SENT = 200_000
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_PIECE = 1 << 20


class ArchiveError(ValueError):
    """The bytes are no archive of the stated kind."""


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes


def arc_version_block(version: int, name: str = "pages.arc") -> bytes:
    body = f"{version} {0 if version == 1 else 1} stratavox\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", NO_DATE, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def header_url(url: str | None) -> str:
    """A url as header lines hold it: spaces and controls percent-encoded, "-" for none."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "-"


def arc_record(version: int, url: str, content: bytes, offset: int = 0, date: str = NO_DATE) -> bytes:
    """One record; spaces and controls in the url are percent-encoded."""
    fields = [header_url(url), "0.0.0.0", date, "text/html"]
    if version == 2:
        fields += ["200", hashlib.md5(content).hexdigest(), "-", str(offset), "pages.arc"]
    return " ".join([*fields, str(len(content))]).encode() + b"\n" + content + b"\n"


class _Stream:
    """Bytes of an archive from its start; a gzipped one is unzipped member by member as it is read."""

    def __init__(self, data: bytes):
        self.raw, self.at = memoryview(data), 0
        self.zipped, self.member = data[:2] == b"\x1f\x8b", None
        self.held, self.pos = bytearray(), 0

    def _more(self) -> bool:
        del self.held[: self.pos]
        self.pos = 0
        before = len(self.held)
        while len(self.held) == before and (self.at < len(self.raw) or self.member is not None):
            chunk = self.raw[self.at : self.at + _PIECE]
            if not self.zipped:
                self.held += chunk
                self.at += len(chunk)
                continue
            if self.member is None:
                self.member = zlib.decompressobj(31)
            try:
                self.held += self.member.decompress(chunk, _PIECE)
            except zlib.error as e:
                raise ArchiveError(f"no gzip member at byte {self.at}: {e}") from None
            self.at += len(chunk) - len(self.member.unconsumed_tail) - len(self.member.unused_data)
            if self.member.eof:
                self.member = None
            elif not len(chunk) and len(self.held) == before:
                raise ArchiveError("a gzip member is cut short")
        return len(self.held) > before

    def ended(self) -> bool:
        return self.pos == len(self.held) and not self._more()

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next ``mark``, which is passed over; None if there is none."""
        looked = self.pos
        while (end := self.held.find(mark, looked)) < 0:
            looked = max(len(self.held) - len(mark) + 1 - self.pos, 0)
            if not self._more():
                return None
        out = bytes(self.held[self.pos : end])
        self.pos = end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or as many as are left."""
        while len(self.held) - self.pos < n and self._more():
            pass
        out = bytes(self.held[self.pos : self.pos + n])
        self.pos += len(out)
        return out


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, the version block first. Data may be gzipped, also member by member."""
    stream, names, version = _Stream(data), None, 0
    while not stream.ended():
        head = stream.until(b"\n")
        if head is None:
            raise ArchiveError("a header line does not end")
        if not head.strip(b"\r"):
            continue
        line = head.decode("utf-8", "replace").rstrip("\r").split(" ")
        try:
            length = int(line[-1])
        except ValueError:
            raise ArchiveError(f"no length in header line {line!r:.80}") from None
        content = stream.take(max(length, 0))
        if length < 0 or len(content) < length:
            raise ArchiveError("a record is cut short")
        if names is None:
            lines = content.decode("utf-8", "replace").splitlines()
            if not line[0].startswith("filedesc:") or len(lines) < 2 or lines[0][:1] not in ("1", "2"):
                raise ArchiveError("no version block")
            version, names = int(lines[0][0]), lines[1].split()
            yield ArcRecord(version, dict(zip(ARC_FIELDS[version].split(), line, strict=False)), content)
            continue
        if len(line) < len(names):
            raise ArchiveError(f"{len(line)} header fields instead of {len(names)}")
        # A url may hold spaces in careless archives; fields are counted from the end.
        tail = line[len(line) - len(names) + 1 :]
        yield ArcRecord(version, dict(zip(names, [" ".join(line[: len(line) - len(tail)]), *tail], strict=True)), content)


def record_id(page_id: int | None, url: str) -> str:
    """A version 8 UUID that carries the page id in its outer 32 bits and a url hash within."""
    low = (page_id or 0) & ((1 << 64) - 1)
    inner = int.from_bytes(hashlib.sha256(url.encode()).digest()[:6], "big") << 16 | (page_id is None)
    value = (low >> 32) << 96 | (inner >> 16 & 0xFFFF) << 80 | 8 << 76 | (inner >> 32 & 0xFFF) << 64 | 2 << 62 | (inner & 0xFFFF) << 32 | low & 0xFFFFFFFF
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(identifier: str) -> int | None:
    """The page id in a record identifier of ``record_id``."""
    value = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 32 & 1:
        return None
    low = (value >> 96) << 32 | value & 0xFFFFFFFF
    return low - (1 << 64) if low >> 63 else low


def _iso(date: str) -> str:
    d = (date + NO_DATE[len(date) :])[:14] if date.isdigit() else NO_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(record: ArcRecord, page_id: int | None = None, refers_to: tuple[int, str] | None = None, source: str = "") -> bytes:
    """A WARC/1.1 record without its closing line breaks; its identifier follows from page_id, url and ``source``.

    A version block becomes warcinfo, content with an HTTP status line response or revisit,
    anything else resource. With ``refers_to``, the page id and header url of the response
    that has the payload, a response is a revisit: it keeps the HTTP header, not the payload.
    """
    url = record.fields.get("URL", "-")
    content = record.content
    headers = [f"WARC-Date: {_iso(record.fields.get('Archive-date', ''))}"]
    if url.startswith("filedesc:"):
        kind, media, block = "warcinfo", "application/warc-fields", b"software: stratavox\r\nformat: WARC File Format 1.1\r\n"
    elif content.startswith(b"HTTP/"):
        head, _, payload = content.partition(b"\r\n\r\n")
        kind, media, block = "response", "application/http; msgtype=response", content
        headers.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
        if refers_to is not None:
            kind, block = "revisit", head + b"\r\n\r\n"
            headers += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*refers_to)}", f"WARC-Refers-To-Target-URI: {refers_to[1]}"]
    else:
        kind, media, block = "resource", record.fields.get("Content-type", "application/octet-stream"), content
        headers.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(content).hexdigest()}")
    if kind != "warcinfo":
        headers.append(f"WARC-Target-URI: {url}")
    headers += [
        f"WARC-Record-ID: {record_id(page_id, source + url)}",
        f"WARC-Type: {kind}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Type: {media}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(["WARC/1.1", *headers]).encode() + b"\r\n\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, by declared lengths; block digests are checked."""
    stream, nth = _Stream(data), 0
    while not stream.ended():
        head = stream.until(RECORD_END)
        if head is None or not head.startswith(b"WARC/"):
            raise ArchiveError(f"no record after {nth}")
        lines = head.decode().split("\r\n")[1:]
        headers = {k: v for k, _, v in (x.partition(": ") for x in lines)}
        block = stream.take(int(headers["Content-Length"]))
        if stream.take(4) != RECORD_END:
            raise ArchiveError("a record is cut short")
        if headers.get("WARC-Block-Digest", "").removeprefix("sha256:") != hashlib.sha256(block).hexdigest():
            raise ArchiveError("a block does not match its digest")
        nth += 1
        yield headers, block


def member(record: bytes) -> bytes:
    """A WARC record with its closing line breaks, as a gzip member."""
    return gzip.compress(record + RECORD_END, mtime=0)


def _runs(members: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows for the text writer: runs of members, each but for the last byte of the empty member it ends with."""
    held, size = [], 0
    for m in members:
        held.append(m)
        size += len(m)
        if size >= RUN_BYTES:
            yield _run(held)
            held, size = [], 0
    if held:
        yield _run(held)


def _run(held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(held) + _EMPTY_MEMBER[:-1]], pa.binary())], names=["value"])


def _write(runs: DataFrame, path: str) -> None:
    """``runs(value binary)`` as files; the cast keeps all bytes as they are."""
    with tidy_shuffles(runs.sparkSession):
        runs.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RUNS).text(path)


def http_response(page_id: int | None, payload: bytes) -> bytes:
    shown = "" if page_id is None else str(page_id)
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {shown}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def _lines(block: bytes) -> dict[str, str]:
    head = block.partition(b"\r\n\r\n")[0].decode("utf-8", "replace").split("\r\n")
    return {k: v.strip() for k, _, v in (x.partition(":") for x in head[1:])}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(page_id, url, payload, first, first_url) rows in chunks of bounded size."""
    held, size = [], 0
    for batch in batches:
        for i in range(len(batch)):
            held.append(tuple(batch.column(k)[i].as_py() for k in range(5)))
            size += len(held[-1][2])
            if len(held) == CHUNK_PAGES or size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """Members of pages, through ARC records of either version in turn."""
    for number, chunk in enumerate(_chunks(batches)):
        version = 1 + number % 2
        parts, size = [arc_version_block(version)], 0
        for page_id, url, payload, _, _ in chunk:
            size += len(parts[-1])
            parts.append(arc_record(version, url or "-", http_response(page_id, payload), size))
        records = read_arc(b"".join(parts))
        info = to_warc(next(records))
        if not number:
            yield member(info)
        for (page_id, _, _, first, first_url), record in zip(chunk, records, strict=True):
            yield member(to_warc(record, page_id, None if first is None else (first, header_url(first_url))))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_id, url, html)`` as WARC files under ``path``, through ARC records.

    html may be text or bytes. Of rows with equal payloads of REVISIT_FROM bytes or more,
    those with the smallest page_id are responses, others revisits of the one with the least
    url. A null page_id is never referred to and never revisits. Rows that repeat a page_id
    and url are one record, written as often, under one identifier. Only digests are grouped;
    pages stay where they are, unless there are so many payloads with copies that these are
    joined by digest, and then only pages that may be copies move.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = F.octet_length("payload") >= REVISIT_FROM
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = rows.where(long).groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = materialize(firsts, "digests")
    n = firsts.count()
    again = long & (F.col("first.page_id") < F.col("page_id"))
    columns = ["page_id", "url", "payload", F.when(again, F.col("first.page_id")).alias("first"), F.when(again, F.col("first.url")).alias("first_url")]
    if n <= MAX_SENT:
        marked = rows.join(F.broadcast(firsts), "digest", "left").select(*columns)
    else:
        bits = key_filter(firsts.select(F.xxhash64("digest").alias("key")), "key", n)
        maybe = long & may_hold(bits, F.xxhash64("digest"))
        copies = rows.where(maybe).join(firsts, "digest", "left").select(*columns)
        marked = copies.union(rows.where(~maybe).select("page_id", "url", "payload", F.lit(None).cast("long"), F.lit(None).cast("string")))
    _write(marked.mapInArrow(lambda batches: _runs(_converted(batches)), "value binary"), path)


def convert_arcs(spark: SparkSession, arcs: str, path: str) -> None:
    """Convert the ARC files under ``arcs``, gzipped or not, to WARC files under ``path``, all records of whatever kind.

    A file is one value to Spark's reader, hence at most 2 GB; an identifier follows from the
    file's name and the record's place in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                for nth, record in enumerate(read_arc(data.as_py())):
                    yield member(to_warc(record, nth, source=name.as_py().rsplit("/", 1)[-1]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(arcs)
    _write(files.select("path", "content").mapInArrow(lambda batches: _runs(run(batches)), "value binary"), path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records under ``path``.

    A response's payload is digested anew and must match its header; a revisit states both
    for the payload it refers to.
    """

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def parse(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data in batch.column(0):
            out = []
            for headers, block in read_warc(data.as_py()):
                kind = headers["WARC-Type"]
                if kind not in ("response", "revisit"):
                    continue
                http = _lines(block)
                stated = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(http["Content-Length"])
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha256(payload).hexdigest() != stated or len(payload) != size:
                        raise ArchiveError("a payload does not match its header")
                shown = http["X-Page-Id"]
                refers = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
                out.append((int(shown) if shown else None, size, stated, kind, refers))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            )

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(batchwise(parse), schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back from them."""
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {REVISIT_FROM} AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {REVISIT_FROM} AND first < page_id THEN first END AS refers_to
FROM m"""
