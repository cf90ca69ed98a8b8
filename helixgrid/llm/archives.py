"""Legacy archives (ARC, versions 1 and 2) to WARC 1.1 records, and back to rows.

An ARC record is one header line and a block of the length it declares. The
line's fields depend on the version that the archive's first record names:
version 1 has URL, IP address, date, type and length; version 2 has result
code, checksum, location, offset and file name before the length. URLs and types
may hold spaces ("text/html; charset=utf-8"), so a line is read around its
address and date; bytes that are no UTF-8 are read as Latin-1. Each record becomes a WARC
record with a synthesised identifier, an ISO timestamp, a type (response for
HTTP blocks, resource for others, revisit for repeated payloads) and SHA-1
digests of block and payload.

Records are written by Spark's text writer (gzip), whose rows pass bytes
through unchanged, so any file system that Spark knows will do; a row holds a
record without its last line feed. A file is one gzip stream of the size of a
shuffle partition (Spark's writer makes no member for each record), so records
are not read by offset. Reading takes the compressed file and inflates it bit by
bit along the declared lengths: a task holds one record, never the inflated file.

Which of several equal payloads is the response is decided on (id, digest)
rows: the largest id per digest is an aggregate that is combined before the
shuffle, and large groups of equal payloads are split by the join.

Defined cases: null html is the empty payload, which counts as a payload like
any other; a null or empty URL is written as `-`; control characters and
line ends in a URL are percent-encoded; rows that share an id and a payload
are all responses if the id is the largest; a null id is never referred to
and is a response only where no equal payload has an id (its record has an
identifier made from its content); very long html is kept whole, a record at a
time; of rows with equal ids each has its own record; further columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, staged

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ID_HEADER = "X-Archive-Id"
_SUFFIX = b"arc2w"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


class ArchiveError(ValueError):
    """The bytes are not an archive of a known version, or end too early."""


@dataclass
class Record:
    url: str
    ip: str
    date: str
    mime: str
    status: str
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes] | None:
        """Headers (lower-case names) and payload of an HTTP response; None for other blocks."""
        if not self.block.startswith(b"HTTP/"):
            return None
        head, mark, payload = self.block.partition(b"\r\n\r\n")
        if not mark:
            head, mark, payload = self.block.partition(b"\n\n")
        lines = head.decode("latin-1").splitlines()[1:]
        return {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines)}, payload


def clean_url(url: str | None) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "").strip() or "-"


def arc_bytes(records: list[Record], version: int = 1, name: str = "pages.arc") -> bytes:
    """An archive of one version block and the records."""
    about = f"{version} 0 export\n{ARC_FIELDS[version]}\n".encode()
    tail = "" if version == 1 else f"200 - - 0 {name} "
    out = [f"filedesc://{name} 0.0.0.0 20240101000000 text/plain {tail}{len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for r in records:
        middle = "" if version == 1 else f"{r.status} - - {at} {name} "
        line = f"{clean_url(r.url)} {r.ip} {r.date} {r.mime} {middle}{len(r.block)}\n".encode("utf-8", "surrogatepass")
        out += [line, r.block, b"\n"]
        at += len(line) + len(r.block) + 1
    return b"".join(out)


#: What a version's line has after the type.
_ARC_TAIL = {1: r"(\d+)", 2: r"(\S+) \S+ \S+ \S+ \S+ (\d+)"}
#: URL, address, date, type and the tail; the last address with a date behind it counts, one of full length before others.
_ARC_LINE = {v: [re.compile(rf"(.*) ([0-9A-Fa-f.:]+|-) ({date}) (.*) {tail}") for date in (r"\d{12,17}", r"\d+")] for v, tail in _ARC_TAIL.items()}


def _decoded(line: bytes) -> str:
    """A header as text: UTF-8, or Latin-1 where it is not."""
    try:
        return line.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return line.decode("latin-1")


class Stream:
    """Bytes that arrive in chunks, read along lines and lengths; what has been read is let go."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at, self.gone = iter(chunks), bytearray(), 0, 0

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        if self.at:
            del self.held[: self.at]
            self.gone += self.at
            self.at = 0
        self.held += chunk
        return True

    @property
    def place(self) -> int:
        return self.gone + self.at

    def ended(self) -> bool:
        while self.at >= len(self.held):
            if not self._more():
                return True
        return False

    def peek(self) -> bytes:
        return b"" if self.ended() else bytes(self.held[self.at : self.at + 1])

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed; None if there is none."""
        start = self.at
        while True:
            i = self.held.find(mark, start)
            if i >= 0:
                out = bytes(self.held[self.at : i])
                self.at = i + len(mark)
                return out
            start = max(self.at, len(self.held) - len(mark) + 1)
            before = start - self.at
            if not self._more():
                return None
            start = self.at + before

    def take(self, n: int) -> bytes:
        """The next n bytes, or as many as there are."""
        while len(self.held) - self.at < n and self._more():
            pass
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out


def arc_records(data: bytes | Stream) -> Iterator[Record]:
    """The records of an archive after its version block, by the declared lengths."""
    src = data if isinstance(data, Stream) else Stream([data])
    version = 0
    while not src.ended():
        if src.peek() in b"\r\n":
            src.take(1)
            continue
        at = src.place
        raw = src.until(b"\n")
        if raw is None:
            raise ArchiveError(f"no end of the header line at byte {at}")
        line = _decoded(raw).rstrip("\r")
        if not version:
            if not line.startswith("filedesc://"):
                raise ArchiveError("the archive does not start with a version block")
            last = line.rsplit(" ", 1)[-1]
            about = src.take(int(last)) if last.isdigit() else b""
            mark = about[:2].strip()
            if mark not in (b"1", b"2"):
                raise ArchiveError(f"unknown archive version {mark!r}")
            version = int(mark)
            continue
        m = next(filter(None, (p.fullmatch(line) for p in _ARC_LINE[version])), None)
        if not m:
            raise ArchiveError(f"bad header line at byte {at}: {line[:80]!r}")
        size = int(m[m.lastindex])
        block = src.take(size)
        if len(block) < size:
            raise ArchiveError(f"the record at byte {at} declares {size} bytes, {len(block)} are left")
        yield Record(m[1], m[2], m[3], m[4], m[5] if version == 2 else "", block)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(key: int | None, content: bytes = b"") -> str:
    """A version-8 UUID that holds the id; without one, it is made from the content."""
    if key is None:
        h = bytearray(hashlib.sha1(b"no id" + content).digest()[:16])
        h[6], h[8] = 0x80 | h[6] & 15 | 1, 0x80 | h[8] & 63
        x = h.hex()
    else:
        b = key.to_bytes(8, "big", signed=True)
        x = (b[:6] + b"\x80\x00\x80" + b[6:] + _SUFFIX).hex()
    return f"{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"


def uuid_key(name: str) -> int | None:
    """The id inside record_uuid's result, if it holds one."""
    b = bytes.fromhex(name.strip("<>").removeprefix("urn:uuid:").replace("-", ""))
    if b[6:9] != b"\x80\x00\x80" or b[11:] != _SUFFIX:
        return None
    return int.from_bytes(b[:6] + b[9:11], "big", signed=True)


def iso_date(date: str) -> str:
    d = re.sub(r"\D", "", date).ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_bytes(record: Record, key: int | None, refers_to: int | None = None) -> bytes:
    """One WARC record; with refers_to, a revisit that keeps the HTTP headers only."""
    http = record.http()
    payload = record.block if http is None else http[1]
    block = record.block
    kind = "resource" if http is None else "response"
    mime = (record.mime or "application/octet-stream") if http is None else "application/http; msgtype=response"
    lines = ["WARC/1.1"]
    if refers_to is not None:
        kind = "revisit"
        block = record.block[: len(record.block) - len(payload)]
    name = record_uuid(key, record.url.encode("utf-8", "surrogatepass") + record.block)
    lines += [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {iso_date(record.date)}",
        f"WARC-Target-URI: {record.url}", f"WARC-IP-Address: {record.ip}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_uuid(refers_to)}>"]
    lines += [f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_records(data: bytes | Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, by the declared lengths."""
    src = data if isinstance(data, Stream) else Stream([data])
    while not src.ended():
        at = src.place
        raw = src.until(b"\r\n\r\n")
        if raw is None or not raw.startswith(b"WARC/"):
            raise ArchiveError(f"no WARC record at byte {at}")
        lines = _decoded(raw).split("\r\n")[1:]
        head = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        block = src.take(size)
        if len(block) < size or src.take(4) != b"\r\n\r\n":
            raise ArchiveError(f"the record at byte {at} does not end after its {size} bytes")
        yield head, block


def _archived(batches, version: int, most: int):
    """Archives of about `most` bytes from batches of (key, url, html)."""
    held: list[Record] = []
    size = 0
    for pdf in batches:
        for k, u, h in zip(pdf["key"], pdf["url"], pdf["html"], strict=True):
            payload = (h or "").encode("utf-8", "surrogatepass")
            own = "" if pd.isna(k) else f"{ID_HEADER}: {int(k)}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
            held.append(Record(u, "0.0.0.0", "20240101000000", "text/html", "200", head.encode() + payload))
            size += len(held[-1].block)
            if size >= most:
                yield arc_bytes(held, version)
                held, size = [], 0
    if held:
        yield arc_bytes(held, version)


def _page_rows(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    # The id travels as text: a nullable integer would become a float in pandas.
    return pages.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))


def pages_to_arcs(pages: DataFrame, version: int = 1, most: int = 8 << 20, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows of pages -> rows of whole archives (`arc`) of about `most` bytes."""

    def run(batches):
        for arc in _archived(batches, version, most):
            yield pd.DataFrame({"arc": [arc]})

    return _page_rows(pages, key, url, html).mapInPandas(run, "arc binary")


def pages_to_records(pages: DataFrame, version: int = 1, most: int = 2 << 20, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows of pages -> the records of their archives: pages_to_arcs and arcs_to_records in one pass, an archive at a time."""

    def run(batches):
        for arc in _archived(batches, version, most):
            yield _parsed(arc)

    return _page_rows(pages, key, url, html).mapInPandas(run, RECORD)


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """Archives under a path, plain or gzipped (members are joined), as rows of whole archives."""

    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"arc": [_inflated(c) for c in pdf["content"]]})

    return mapped(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content"), batch, "arc binary")


def _chunks(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file in pieces, inflated if it is gzip; members follow each other."""
    view = memoryview(data)
    if view[:2] != b"\x1f\x8b":
        for i in range(0, len(view), most):
            yield bytes(view[i : i + most])
        return
    at = 0
    while view[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = z.unconsumed_tail or bytes(view[at : at + most])
            if not z.unconsumed_tail:
                at += len(piece)
            out = z.decompress(piece, most)
            if not out and not piece:
                raise ArchiveError("a gzip member ends too early")
            if out:
                yield out
        at -= len(z.unused_data)


def _inflated(data: bytes) -> bytes:
    return b"".join(_chunks(data))


RECORD = "id long, url string, ip string, date string, mime string, status string, digest string, block binary"


def _parsed(arc: bytes) -> pd.DataFrame:
    rows = []
    for r in arc_records(arc):
        http = r.http()
        own = http and http[0].get(ID_HEADER.lower())
        rows.append((own or None, r.url, r.ip, r.date, r.mime, r.status, sha1_base32(http[1] if http else r.block), r.block))
    out = pd.DataFrame(rows, columns=["id", "url", "ip", "date", "mime", "status", "digest", "block"])
    return out.assign(id=pd.array([None if x is None else int(x) for x in out["id"]], dtype="Int64"))


def arcs_to_records(arcs: DataFrame) -> DataFrame:
    """Rows of whole archives -> rows of records with the payload's digest."""

    def run(batches):
        for pdf in batches:
            for arc in pdf["arc"]:
                yield _parsed(arc)

    return arcs.select("arc").mapInPandas(run, RECORD)


def write_warcs(records: DataFrame, path: str) -> None:
    """Writes WARC files; of records with equal payloads the one with the largest id is kept whole."""
    # The digests are needed more than once, the blocks are not: they are parsed once for each.
    seen = staged(records.select("id", "digest"), "digests")
    chosen = seen.groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("digest", "top")
    revisits = seen.join(chosen, "digest").where("id is null or id <> top").select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "top").distinct()
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    marked = records.join(revisits, same, "left").select(F.col("id").cast("string").alias("id"), "url", "ip", "date", "mime", "status", "block", F.col("top").cast("string").alias("top"))

    def run(batches):
        for pdf in batches:
            rows = []
            for k, u, ip, d, m, s, b, top in zip(*(pdf[c] for c in ("id", "url", "ip", "date", "mime", "status", "block", "top")), strict=True):
                rows.append(warc_bytes(Record(u, ip, d, m, s, bytes(b)), None if k is None else int(k), None if top is None else int(top))[:-1])
            yield pd.DataFrame({"value": rows})

    marked.mapInPandas(run, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """id, record_type, payload_digest, payload_bytes, refers_to, url, date of each record; digests of kept payloads are checked."""

    def shaped(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["id", "record_type", "payload_digest", "payload_bytes", "refers_to", "url", "date"])
        # Through objects: a list of integers with gaps would become floats, and large ids would lose digits.
        return out.assign(**{c: pd.array([r[i] for r in rows], dtype="Int64") for c, i in (("id", 0), ("refers_to", 4))})

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for head, block in warc_records(Stream(_chunks(content))):
                    kind = head["warc-type"]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    http = Record("", "", "", "", "", block).http() if kind == "response" else None
                    payload = http[1] if http else block
                    if kind != "revisit" and (sha1_base32(payload) != digest or len(payload) != int(head["x-payload-length"])):
                        raise ArchiveError(f"payload of {head['warc-record-id']} does not match its digest")
                    refers = uuid_key(head["warc-refers-to"]) if "warc-refers-to" in head else None
                    rows.append((uuid_key(head["warc-record-id"]), kind, digest, int(head["x-payload-length"]), refers, head["warc-target-uri"], head["warc-date"]))
                    if len(rows) == 10_000:
                        yield shaped(rows)
                        rows = []
                yield shaped(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, date string")
