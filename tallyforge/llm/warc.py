"""WARC archives: written by Spark as ordinary files, and read back even where they are damaged.

A record is a gzip member of its own. The reader takes members and plain records one after another and checks what each
claims: the member's CRC, the version line, the length of the block, the empty line behind it and the digests. Where a
check fails it searches for the next place at which a whole record passes them all, goes on from there, and reports
the bytes between as a quarantined gap. Records and gaps of a file cover it without overlap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote
from uuid import UUID, uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, shared_folder, table

#: Bytes of a payload from which an equal one is not stored again.
REVISITED = 1000
#: Records of a file, and bytes of payloads handed on at a time.
RECORDS, HANDED = 10_000, 1 << 23
# fixed values: the version line, the profile of revisits and the date that records carry unless another is given
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
#: The last field of a header that is written here: the digest of all header lines before it, which else nothing protects.
SIGNED = b"Header-Digest:"
EMPTY_MEMBER = zlib.compressobj(wbits=31).flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(text: str) -> str:
    """A header value: nothing in it can end the line."""
    return quote(text, safe="".join(map(chr, range(0x21, 0x7F))))


def record_id(page_id: int | None, url: str | None) -> str:
    """The same page has the same id in every run."""
    return f"<urn:uuid:{UUID(bytes=hashlib.md5(f'{page_id}\n{url}'.encode('utf-8', 'surrogatepass')).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response with its HTTP header and payload, or a revisit that names the page of the response instead."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    named = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, url)), ("WARC-Date", date), ("WARC-Target-URI", _line(url or f"urn:page:{page_id}")),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", _sha1(block)), ("WARC-Payload-Digest", _sha1(payload)),
    ]
    if page_id is not None:
        named.append(("Page-Id", str(page_id)))
    if refers_to is not None:
        named += [("WARC-Profile", PROFILE), ("Refers-To-Page-Id", str(refers_to))]
    named.append(("Content-Length", str(len(block))))
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in named).encode()
    return head + f"{SIGNED.decode()} {_sha1(head)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _members(compressed: bool):
    """Records as the lines of a text file whose line ends with a byte that closes the record anyway."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (c[i].as_py() for c in columns)
                data = record(page_id, url, html or b"", refers_to)
                if compressed:
                    data = member(data)
                    # a member ends with its length; where that does not end in a zero byte, an empty one follows
                    data = data if data[-1:] == b"\0" else data + EMPTY_MEMBER
                out.append(data[:-1])
                size += len(data)
                if size > HANDED:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return made


def with_revisits(pages: DataFrame, least: int = REVISITED) -> DataFrame:
    """(page_id, url, html binary, refers_to): of pages with equal payloads of at least `least` bytes the largest page_id stays,
    the others refer to it. Repeated rows of that page_id stay too; a null page_id counts as the smallest."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    key = {"n": F.octet_length("html"), "d": F.sha1("html"), "h": F.xxhash64("html")}
    keyed = rows.withColumns(key)
    groups = keyed.where(F.col("n") >= least).groupBy(*key).agg(F.max("page_id").alias("last"), F.min("page_id").alias("least"), F.count_if(F.col("page_id").isNull()).alias("nulls"))
    groups = cut(groups.where("last IS NOT NULL AND (least < last OR nulls > 0)").select(*key, "last"), "equal-payloads")  # of known size, so that pages need not move for a few
    joined = keyed.join(groups, list(key), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, compressed: bool = True) -> None:
    """A file for each task and RECORDS of its rows (page_id, url, html binary, refers_to); a lost task is written again whole."""
    made = rows.select("page_id", "url", "html", "refers_to").mapInArrow(_members(compressed), "record binary")
    lines = made.select(F.col("record").cast("string").alias("record"))  # the bytes as they are
    lines.write.option("lineSep", "\0" if compressed else "\n").option("maxRecordsPerFile", RECORDS).text(folder)


class Found(NamedTuple):
    offset: int
    length: int
    reason: str | None  # why the bytes are quarantined; null for a record
    headers: dict[str, str]
    payload: bytes


class Damaged(ValueError):
    pass


_START = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]+\.[0-9]+\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def _same_digest(claimed: str, data: bytes) -> bool:
    """Whether data has the digest that a header claims, in base 32 or 16; digests of other kinds are not judged."""
    kind, _, value = claimed.partition(":")
    try:
        digest = hashlib.new(kind.lower().replace("-", ""), data).digest()
    except ValueError:
        return True
    return value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=") or value.lower() == digest.hex()


def plain_record(data: bytes, at: int = 0) -> tuple[int, dict[str, str], bytes]:
    """(end, headers by lower-case name, payload) of the record that begins at a place; Damaged says which check failed."""
    start = _START.match(data, at)
    if not start:
        raise Damaged("no version line")
    ended = _HEAD_END.search(data, start.end() - 1)
    if not ended:
        raise Damaged("the header does not end")
    headers: dict[str, str] = {}
    for line in data[start.end() : ended.start()].decode("utf-8", "replace").splitlines():
        name, colon, value = line.partition(":")
        if line[:1] in " \t" and headers:  # a continued line
            headers[list(headers)[-1]] += " " + line.strip()
        elif not colon:
            raise Damaged("a header line has no name")
        else:
            headers[name.strip().lower()] = value.strip()
    signed = data.rfind(b"\n" + SIGNED, at, ended.start()) + 1
    if signed and not _same_digest(headers.get("header-digest", ""), data[at:signed]):
        raise Damaged("the header is not what its digest says")
    if not headers.get("content-length", "").isascii() or not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    first, last = ended.end(), ended.end() + int(headers["content-length"])
    if data[last : last + 4] == b"\r\n\r\n":
        end = last + 4
    elif data[last : last + 2] == b"\n\n":
        end = last + 2
    else:
        raise Damaged("no empty line behind the block")
    block = data[first:last]
    if "warc-block-digest" in headers and not _same_digest(headers["warc-block-digest"], block):
        raise Damaged("the block is not what its digest says")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        http = _HEAD_END.search(block)
        payload = block[http.end() :] if http else b""
    if headers.get("warc-type") != "revisit" and "warc-payload-digest" in headers and not _same_digest(headers["warc-payload-digest"], payload):
        raise Damaged("the payload is not what its digest says")
    return end, headers, payload


def _inflated(data: bytes, at: int, step: int = 1 << 14) -> tuple[bytes, int, str | None]:
    """(content, end, fault) of the gzip member at a place; with a fault the content goes as far as whole steps could be read."""
    pack, parts, view = zlib.decompressobj(31), [], memoryview(data)
    while not pack.eof:
        if at >= len(data):
            return b"".join(parts), at, "the member is cut off"
        chunk = view[at : at + step]
        try:
            parts.append(pack.decompress(chunk))
        except zlib.error as error:
            return b"".join(parts), at, f"the member cannot be read: {error}"
        at += len(chunk) - len(pack.unused_data)
    return b"".join(parts), at, None


def _at(data: bytes, at: int) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
    """(end, records) of what begins at a place, all of its checks passed."""
    if data[at : at + 2] != b"\x1f\x8b":
        end, headers, payload = plain_record(data, at)
        return end, [(headers, payload)]
    content, end, fault = _inflated(data, at)
    if fault:
        raise Damaged(fault)
    found, inner = [], 0
    while inner < len(content):
        inner, headers, payload = plain_record(content, inner)
        found.append((headers, payload))
    return end, found


def salvaged(data: bytes) -> Iterator[Found]:
    """Records and gaps of a file in order. A gap reaches from a record that fails to the next that passes all checks.

    Records that a failing gzip member still holds whole, digests included, are given at the member's place with a length of
    0, and its bytes are a gap all the same. An empty member belongs to the record before it.
    """
    at = 0
    while at < len(data):
        begin, reason, end, records = at, None, len(data), []
        while True:
            try:
                end, records = _at(data, at)
                break
            except Damaged as fault:
                if reason is None:
                    reason = str(fault)
                    if data[at : at + 2] == b"\x1f\x8b":
                        yield from _partial(data, at)
            following = _NEXT.search(data, at + 1)
            if not following:
                at, end = len(data), len(data)
                break
            at = following.start()
        if reason is not None:
            yield Found(begin, at - begin, reason, {}, b"")
        for k, (headers, payload) in enumerate(records):
            yield Found(at, (end - at) if k == 0 else 0, None, headers, payload)
        if at < len(data) and not records:
            yield Found(at, end - at, None, {}, b"")
        at = end


def _partial(data: bytes, at: int) -> Iterator[Found]:
    """Whole records within a member that fails, if they carry a digest to be checked by."""
    for x in salvaged(_inflated(data, at, 64)[0]):
        if x.reason is None and "warc-block-digest" in x.headers:
            yield Found(at, 0, None, x.headers, x.payload)


FIELDS = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
READ = "path string, offset long, length long, reason string, headers map<string, string>, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), FIELDS)], [n for n, _ in FIELDS])
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            rows, size = [], 0
            for x in salvaged(content.as_py()):
                if x.reason is None and not x.headers:
                    continue  # an empty member
                rows.append((path.as_py(), x.offset, x.length, x.reason, list(x.headers.items()), None if x.reason else x.payload))
                size += len(x.payload) + 500
                if size > HANDED:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, reason, headers, payload): a row for each record, with names of headers in lower case, and for each gap.

    A gap has a reason and no payload. A file, gzip members and plain records mixed as they may be, is read by one task and
    held whole, as Spark's binary files are, of which none may exceed 2 GB. Empty files give no rows.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_read, READ)


def payloads(records: DataFrame) -> DataFrame:
    """Records -> (page_id, record_type, refers_to, payload_bytes, payload_digest): a revisit has the bytes of the response that it refers to.

    The digest is that of the payload as read, for revisits the one claimed, which has to be the response's; a revisit whose response is
    lost has no bytes.
    """
    of = lambda name: F.col("headers")[name]
    rows = records.where("reason IS NULL").select(
        of("page-id").cast("long").alias("page_id"), of("warc-type").alias("record_type"), of("refers-to-page-id").cast("long").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), of("warc-payload-digest").alias("claimed"),
    )
    rows = cut(rows, "archive-records")
    revisits = rows.where("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("target")).distinct()
    stored = rows.where("record_type = 'response'").join(wanted, F.col("page_id") == F.col("target"), "left_semi")
    stored = stored.groupBy(F.col("page_id").alias("target"), F.col("claimed").alias("said")).agg(F.max("payload_bytes").alias("bytes"), F.max("payload_digest").alias("digest"))
    resolved = revisits.join(stored, (F.col("refers_to") == F.col("target")) & (F.col("claimed") == F.col("said")), "left")
    columns = ["page_id", "record_type", "refers_to"]
    out = rows.where("record_type <> 'revisit'").select(*columns, "payload_bytes", "payload_digest")
    return out.unionAll(resolved.select(*columns, F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")))


def op13_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back, a row for each row of pages.

    A null html is an empty payload, a null or odd url is written as far as a header line can hold it, rows repeated with one
    page_id and payload are all of the record type that the page_id has. An empty table gives no rows; other columns are not read.
    """
    folder = f"{shared_folder(spark)}/archives-{uuid4().hex}"
    write_archives(with_revisits(table(spark, sf_dir, "pages")), folder)
    found = payloads(read_archives(spark, folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= {REVISITED} AND last IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISITED} AND last IS DISTINCT FROM page_id THEN last END AS refers_to FROM m"""
