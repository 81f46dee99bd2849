"""WARC archives: writer and salvage reader (operator 6).

Writing. Each row becomes one record, compressed as a gzip member of its own. Of the rows with equal payloads of
at least REVISIT bytes the one with the largest key is the response; the others are revisit records that refer to
it and leave the payload out. Archives go through Spark's text writer, whose commit protocol survives lost
executors and which reaches any store: a row is the member without its last byte, and the "line separator" is that
byte, zero in every member (the high byte of a size under 16 MB; a longer record is followed by an empty member).
The writer begins a new file after `records` rows; a record that is larger than its share of ARCHIVE bytes is followed
by empty members for the shares that it takes besides, so a file has no more than ARCHIVE bytes and one record.

Reading. A record is taken if its member inflates with the right checksum and the version line, header, length, end
and digest of the record hold. If a check of a record fails, the reader searches for the next version line, within a
member in its content, from which a valid record can be read, and goes on there. If a member breaks off or its checksum
fails, its content as far as it inflates is searched in the same way, but only records whose own digest holds are taken.
A digest does not cover a record's header. So where the checksum of a whole stream fails although every record passes, a
header may be damaged, and none is taken, unless the checksum itself is what is damaged: one field of the trailer holds
and the other differs in one byte at most. Of a member that breaks off, the record in which or with which it does is not
taken. Then the reader goes on at the next gzip magic number or version line from which something valid can be read that
was not taken already (a member may store its content as it is). What lies between is reported as a quarantined gap: bytes of the archive, and for one inside a member its place in the content
beside the member's. A record lost in a gap takes no others with it but those that the broken stream hides.

Defined results: a null payload is empty; a null url is left out of the header; a null key gives a record without a
key, never the target of a revisit; repeated rows, and rows that tie for the largest key, are all responses; an
empty table gives archives without records; other columns are not read. Payloads are kept whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import HOT, lookup, map_arrow, slices, utf8
from tramline.store import stage

#: Bytes from which an equal payload is written as a revisit.
REVISIT = 1000
#: Records in an archive at most, so that a reader can hold it.
RECORDS = 5000
#: Bytes of an archive, beside its last record.
ARCHIVE = 64 << 20
LEVEL = 3

_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
# The record types of WARC 1.1.
_TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}
_URN = "urn:tramline:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = zlib.compress(b"", LEVEL, 31)
#: What is wrong with a member that inflates.
BROKEN_OFF, CHECKSUM = "member without end", "checksum differs"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if key is not None:
        lines.append(f"WARC-Record-ID: <{_URN}{key}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member, or two, that ends in a zero byte."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    data = packer.compress(raw) + packer.flush()
    return data if data[-1] == 0 else data + _EMPTY


def write(df: DataFrame, path: str, key: str, url: str = "url", payload: str = "html", records: int = RECORDS) -> None:
    """Write archives to a folder."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("bytes"))
    # Of the other rows of a digest only the largest key matters, and sums per task come before the shuffle.
    first = rows.where(F.col("bytes") >= REVISIT).groupBy("digest").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stage(first, "warc-copies")
    most = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HOT
    joined = lookup(rows, first.drop("n"), "digest", first.where(F.col("n") > most), ["key", "url", "digest"], needless=F.col("bytes") < REVISIT)
    target = F.when((F.col("bytes") >= REVISIT) & ~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    share = max(1, ARCHIVE // records)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keys, urls, digests, targets = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            lines = []
            for r in zip(keys, urls, utf8(batch.column(2)), digests, targets, strict=True):
                data = member(record(*r))
                lines += [data[:-1], *[_EMPTY[:-1]] * (len(data) // share)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])

    packed = map_arrow(joined.select("key", "url", "payload", "digest", target.alias("refers_to")), pack, "value binary")
    lines = packed.select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)


@dataclass
class Found:
    """A record, or with a reason a gap, at a place in the archive's bytes, or at one in the content of the member there."""

    offset: int
    length: int
    reason: str | None = None
    inner_offset: int | None = None
    inner_length: int | None = None
    header: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    payload_bytes: int = 0


def _http(block: bytes) -> tuple[bytes, int | None]:
    """The payload of an HTTP response, and the length that its header gives."""
    head, _, payload = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length: *(\d+)", head)
    return payload, int(m[1]) if m else None


def _record(data: bytes, at: int = 0, sure: bool = False) -> tuple[Found, int]:
    """The record at a place, and where it ends; ValueError if a check fails, or if sure and it has no digest to check."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header without end")
    header = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header")
        header[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if header.get("warc-type") not in _TYPES:
        raise ValueError("unknown type")
    if not header.get("content-length", "").isdecimal():
        raise ValueError("no length")
    start, stop = end + 4, end + 4 + int(header["content-length"])
    block = data[start:stop]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("wrong length")
    digest = header.get("warc-block-digest", "")
    if sure and not digest.startswith("sha1:"):
        raise ValueError("no digest in a damaged member")
    if digest.startswith("sha1:") and digest[5:] != hashlib.sha1(block).hexdigest():
        raise ValueError("block digest differs")
    payload, length = _http(block) if header.get("content-type", "").startswith("application/http") else (block, len(block))
    if header.get("warc-type") == "response":
        digest = header.get("warc-payload-digest", "")
        if digest.startswith("sha1:") and digest[5:] != hashlib.sha1(payload).hexdigest():
            raise ValueError("payload digest differs")
        length = len(payload)
    return Found(at, stop + 4 - at, header=header, payload=payload, payload_bytes=length or 0), stop + 4


def _inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at a place as far as it inflates, where that ends, and what is wrong, if anything."""
    unpack, out, view = zlib.decompressobj(31), [], memoryview(data)
    begin, careful = at, False
    while not unpack.eof:
        piece = view[at : at + step]
        if not piece:
            return b"".join(out), at, BROKEN_OFF
        before = unpack.copy() if careful else None
        try:
            out.append(unpack.decompress(piece))
        except zlib.error as e:
            if before is None:  # from the beginning again, now with a state to go back to before each piece
                unpack, out, at, careful = zlib.decompressobj(31), [], begin, True
            elif step == 1:
                # Checksum and length are compared at their last bytes, the fourth and the eighth of the trailer.
                for field, end in (("data check", at + 5), ("length check", at + 1)):
                    if field in str(e):
                        return b"".join(out), end, CHECKSUM
                return b"".join(out), at, "member is damaged"
            else:
                unpack, step = before, step // 16
            continue
        at += len(piece) - len(unpack.unused_data)
    return b"".join(out), at, None


def _inside(content: bytes, sure: bool) -> Iterator[Found]:
    """Records and gaps of a member's content, by their places there."""
    at = 0
    while at < len(content):
        try:
            found, end = _record(content, at, sure)
            yield found
            at = end
        except ValueError as e:
            gap = at
            while (m := _VERSION.search(content, at + 1)) and not _reads(content, m.start(), sure):
                at = m.start()
            at = m.start() if m else len(content)
            yield Found(gap, at - gap, str(e))


def _damaged(content: bytes, trailer: bytes, wrong: str) -> list[Found]:
    """Records and gaps of the content of a member with a fault: records only where the fault leaves them certain."""
    found = list(_inside(content, True))
    if wrong == BROKEN_OFF and found:
        found[-1].reason = found[-1].reason or wrong
    elif wrong == CHECKSUM and not _trailer_alone(content, trailer) and all(f.reason is None for f in found):
        for f in found:
            f.reason = wrong
    return found


def _trailer_alone(content: bytes, trailer: bytes) -> bool:
    """Whether a member's content bears out its trailer but for one field's byte, so that the content is not what is damaged."""
    if len(trailer) < 8:
        return False
    own = zlib.crc32(content).to_bytes(4, "little") + (len(content) & 0xFFFFFFFF).to_bytes(4, "little")
    crc, size = (sum(a != b for a, b in zip(own[k : k + 4], trailer[k : k + 4], strict=True)) for k in (0, 4))
    return crc == 0 or (crc == 1 and size == 0)


def _reads(data: bytes, at: int, sure: bool = False) -> bool:
    """Whether something valid can be read at a place."""
    if not data.startswith(_GZIP, at):
        try:
            return bool(_record(data, at, sure))
        except ValueError:
            return False
    content, end, wrong = _inflate(data, at)
    return wrong is None or any(f.reason is None for f in _damaged(content, data[end - 8 : end], wrong))


def _same(found: Found) -> tuple:
    return *found.header.items(), hashlib.sha1(found.payload).digest()


def _onward(data: bytes, at: int, taken: Counter) -> int:
    """The next place from which something valid can be read; a member that stores its content shows the records taken from it once more."""
    while m := _CANDIDATE.search(data, at + 1):
        at = m.start()
        if data.startswith(_GZIP, at):
            if _reads(data, at):
                return at
            continue
        try:
            found, end = _record(data, at)
        except ValueError:
            continue
        if not taken[_same(found)]:
            return at
        taken[_same(found)] -= 1
        at = end - 1
    return len(data)


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive that can be read, and the gaps between them, in order."""
    at = 0
    while at < len(data):
        inner: list[Found] = []
        if data.startswith(_GZIP, at):
            content, end, wrong = _inflate(data, at)
            inner = list(_inside(content, False)) if wrong is None else _damaged(content, data[end - 8 : end], wrong)
        else:
            try:
                found, at = _record(data, at)
                yield found
                continue
            except ValueError as e:
                end, wrong = at, str(e)
        start = at
        if wrong is None:
            at = end
        else:
            at = _onward(data, at, Counter(_same(f) for f in inner if f.reason is None))
        for f in inner:
            if f.reason is None or wrong is None:
                f.inner_offset, f.inner_length, f.offset, f.length = f.offset, f.length, start, at - start
                yield f
        if wrong is not None:
            yield Found(start, at - start, wrong)


def damaged(files: DataFrame, every: int) -> DataFrame:
    """Archives with bits changed in the middle of the members of pages divisible by `every`, to try the reader on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = []
            for content in batch.column(1):
                data = bytearray(content.as_py())
                for f in salvage(bytes(data)):
                    if f.reason is None and (key := page_of(f.header.get("warc-record-id"))) is not None and key % every == 0:
                        data[f.offset + f.length // 2] ^= 0xFF
                out.append(bytes(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return map_arrow(files, run, "path string, content binary")


def page_of(uri: str | None) -> int | None:
    """The key in a record's id."""
    m = re.search(rf"{_URN}(-?\d+)", uri or "")
    return int(m[1]) if m else None


READ = "path string, offset long, length long, inner_offset long, inner_length long, gap string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(spark: SparkSession, path: str, with_payload: bool = False, glob: str = "part-*") -> DataFrame:
    """Records and gaps of the archives in a folder: READ; gap says why bytes are quarantined, null for records."""
    return read_contents(archives(spark, path, glob), with_payload)


def read_contents(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """read() of archives given as path and content."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for f, k in (c.split() for c in READ.split(", "))])

        def row(path: str, f: Found) -> dict:
            h = f.header
            fixed = {"path": path, "offset": f.offset, "length": f.length, "inner_offset": f.inner_offset, "inner_length": f.inner_length, "gap": f.reason}
            if f.reason:
                return fixed
            digest = hashlib.sha1(f.payload).hexdigest() if h.get("warc-type") == "response" else h.get("warc-payload-digest", "").removeprefix("sha1:")
            return fixed | {
                "page_id": page_of(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "payload_bytes": f.payload_bytes, "payload_digest": digest,
                "record_type": h.get("warc-type"), "refers_to": page_of(h.get("warc-refers-to")), "payload": f.payload if with_payload else None,
            }

        for batch in slices(batches, 1):
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for f in salvage(content.as_py()):
                    rows.append(row(name, f))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(files, parse, READ)


def archives(spark: SparkSession, path: str, glob: str = "part-*") -> DataFrame:
    """path and content of the archives in a folder; the writer bounds their bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
