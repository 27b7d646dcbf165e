"""WARC archives of gzip members: a writer with revisit records, and a splittable reader.

``write`` makes one gzip member per page. Of pages with equal payloads of ``least`` bytes or
more the one with the largest id is a response, the others are revisits that name it.
``read`` splits archives into byte ranges. A task looks for the gzip magic in its range; a
candidate counts when its first bytes inflate to a WARC version line, and the record belongs to
the range in which its member starts, however far it reaches. Between members the search goes
on behind the last one, so nothing inside a member is taken for another.

Defined cases: a null payload is empty; a null url is left out of the record; rows that
repeat (id, payload) are responses all of them; a page without an id is always a response. A
member that breaks off or does not inflate is no record. Other columns are ignored.
"""

import base64
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.llm.files import TaskFile, byte_ranges, opened, qualified
from quercus.llm.words import chunks
from quercus.workspace import Workspace

LEAST = 0
BLOCK_BYTES = 8 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
#: Bytes read at a time behind a range's end.
AHEAD = 1 << 18
#: Compressed bytes that are inflated to see a version line.
PEEK = 512
RECORDS = (
    "file string, offset long, record_type string, page_id long, target_uri string, payload_digest string, "
    "payload_bytes long, refers_to long, payload binary"
)
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def member(page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One page as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def base32(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def _writer(folder: str, date: str):
    def run(batches):
        file = None
        for table in chunks(batches, "payload"):
            for row in zip(*(table.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                file = file or TaskFile(folder, ".warc.gz")
                page, url, payload, digest, refers = row
                file.write(member(page, url, payload, base32(digest), refers, date))
        if file:
            file.close()
            yield pa.record_batch([pa.array([file.url]), pa.array([file.size])], names=["file", "bytes"])

    return run


def write(pages: DataFrame, ws: Workspace, least: int = LEAST, date: str = DATE) -> DataFrame:
    """Write archives; returns their names (file, bytes)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    # one row per repeated payload, whatever its number of pages; the long side of the join stays as dealt
    repeated = (
        rows.select("page_id", "digest", F.octet_length("payload").alias("n"))
        .where((F.col("n") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("other"))
        .where("keeper > other")
        .select(F.col("digest").alias("same"), "keeper")
    )
    cast = rows.join(repeated, F.col("digest") == F.col("same"), "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("keeper"), F.col("keeper")).alias("refers_to")
    )
    folder = qualified(ws.spark, ws.path("warc"))
    return ws.table(cast.mapInArrow(_writer(folder, date), "file string, bytes long"), "archives")


class Window:
    """The bytes of a file from ``start`` on, read as far as asked."""

    def __init__(self, stream, start: int, size: int, total: int):
        self.stream, self.start, self.total = stream, start, total
        self.data = bytearray(stream.read_at(size, start))

    def upto(self, end: int) -> bool:
        """Whether the bytes before ``end`` (relative) are there; reads them if the file has them."""
        while len(self.data) < end:
            at = self.start + len(self.data)
            if at >= self.total:
                return False
            self.data += self.stream.read_at(min(max(AHEAD, end - len(self.data)), self.total - at), at)
        return True


def _is_record(window: Window, at: int) -> bool:
    window.upto(at + PEEK)
    try:
        return zlib.decompressobj(31).decompress(bytes(window.data[at : at + PEEK]), 16).startswith(b"WARC/")
    except zlib.error:
        return False


def _inflate(window: Window, at: int):
    """(content, where the member ends), or None if it breaks off."""
    inflater, out, place, step = zlib.decompressobj(31), [], at, 1 << 16
    try:
        while not inflater.eof:
            if not window.upto(place + 1):
                return None
            part = bytes(window.data[place : place + step])
            out.append(inflater.decompress(part))
            place += len(part)
    except zlib.error:
        return None
    return b"".join(out), place - len(inflater.unused_data)


def members(window: Window, size: int):
    """(offset, content) of the members that start within the first ``size`` bytes."""
    at = 0
    while True:
        window.upto(size + len(MAGIC))
        at = window.data.find(MAGIC, at, size + len(MAGIC) - 1)
        if at < 0 or at >= size:
            return
        found = _inflate(window, at) if _is_record(window, at) else None
        if found is None:
            at += 1
            continue
        yield window.start + at, found[0]
        at = found[1]


def parsed(content: bytes):
    """(headers, block) of every record in a member's content."""
    at = 0
    while content.startswith(b"WARC/", at):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        try:
            size = int(headers.get("content-length", "0"))
        except ValueError:
            return
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _page(urn: str | None):
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _reader(payloads: bool):
    import hashlib

    def run(batches):
        for batch in batches:
            for url, start, size in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "bytes")), strict=True):
                fs, path = opened(url)
                rows, held = [], 0
                with fs.open_input_file(path) as stream:
                    for offset, content in members(Window(stream, start, size, stream.size()), size):
                        for headers, block in parsed(content):
                            kind = headers.get("warc-type")
                            http, _, payload = block.partition(b"\r\n\r\n")
                            digest = headers.get("warc-payload-digest", "").partition(":")[2] or None
                            length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                            if kind == "response":
                                digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                            else:
                                length = int(length[1]) if length else None
                            rows.append(
                                (url, offset, kind, _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), digest,
                                 length, _page(headers.get("warc-refers-to")), payload if payloads and kind == "response" else None)
                            )
                            held += len(payload)
                        if held > 16 << 20:
                            yield _records(rows)
                            rows, held = [], 0
                yield _records(rows)

    return run


def _records(rows):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read(archives: DataFrame, ws: Workspace, block: int = BLOCK_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the archives in column ``file``; ``payloads=False`` leaves the payloads themselves out."""
    return byte_ranges(archives, block, ws).mapInArrow(_reader(payloads), RECORDS)


def round_trip(pages: DataFrame, ws: Workspace) -> DataFrame:
    """Write ``pages`` and read what the archives say of them."""
    return read(write(pages, ws), ws, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
