"""WARC archives: written with segmented and chunked records, read back into whole payloads.

Writing: a page becomes a `response` record whose block is an HTTP message in chunked transfer
framing. A block longer than a segment goes on in `continuation` records that name the first one
as their origin and carry their number; the last states the total length. Of pages with equal
payloads the smallest page_id is the response, the others are `revisit` records that refer to it.
Records go through Spark's text writer, whose line separator is the blank line that ends a record.

Reading: files are parsed by the lengths that their records state, continuations are grouped by
origin, put in the order of their numbers, checked against the total length and digest, and their
framing is taken off.

Results: a null html is an empty payload. A page with a null page_id can't be referred to; it
is a response unless a numbered page has its payload. Equal rows give equal results, each its own;
rows that share a page_id but differ are kept apart. Payloads shorter than `min_bytes` are all
responses. Broken archives raise an error that names what is wrong.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pantryline.llm.common import batches, staged

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: With at most SEGMENT_BYTES and a header a record, a file stays below about 30 MB.
FILE_RECORDS = 1500
VERSION = b"WARC/1.1\r\n"
RECORD_END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size is cut off")
        size = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        out.append(data[at : at + size])
        at += size + 2


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, object], block: bytes) -> bytes:
    """A record without the blank line that ends it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"".join([VERSION, lines.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block])


def _one_line(url: str | None) -> str:
    return " ".join((url or "").split()) or "urn:none"


def page_records(page_id, url, payload: bytes, refers_to, refers_url, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page; `refers_to` is the response's page_id for a revisit, else None."""
    digest, uri = base32_sha1(payload), _one_line(url)
    name = lambda page, address: f"<urn:page:{page}:{hashlib.sha1(address.encode()).hexdigest()}:{digest}>"
    own = name(page_id, uri)
    common = {
        "WARC-Record-ID": own, "WARC-Target-URI": uri, "WARC-Date": "1970-01-01T00:00:00Z",
        "X-Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        refers = {"WARC-Refers-To": name(refers_to, _one_line(refers_url)), "X-Refers-To-Page-ID": refers_to}
        block = status + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record({"WARC-Type": "revisit", **common, "WARC-Profile": PROFILE, **refers}, block)
        return
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record({"WARC-Type": "response", **common}, block)
        return
    yield record({"WARC-Type": "response", **common, "WARC-Segment-Number": 1}, block[:segment_bytes])
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        yield record(
            {
                "WARC-Type": "continuation",
                "WARC-Record-ID": f"{own[:-1]}:{number}>",
                "WARC-Date": common["WARC-Date"],
                "WARC-Segment-Origin-ID": own,
                "WARC-Segment-Number": number,
                "WARC-Segment-Total-Length": len(block) if at + segment_bytes >= len(block) else None,
            },
            block[at : at + segment_bytes],
        )


def write_warc(
    pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS
) -> None:
    """Archive the rows of (page_id, url, html) below `path`."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Payloads that occur once need no partner; what is left is written, so its size is known to the join.
    shared = staged(
        rows.filter((F.octet_length("html") >= min_bytes))
        .groupBy("digest")
        .agg(
            F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")),
        "shared-payloads",
    )
    revisit = F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))
    paired = rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"), "first_url"
    )

    def records(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for page_id, url, text, refers_to, refers_url in zip(*part.columns, strict=True):
                payload = text.as_py().encode()
                for one in page_records(
                    page_id.as_py(), url.as_py(), payload, refers_to.as_py(), refers_url.as_py(), segment_bytes
                ):
                    yield (one,)

    (
        paired.mapInArrow(lambda parts: batches(records(parts), ["record"], [pa.binary()], 256), "record binary")
        .select(F.col("record").cast("string").alias("value"))  # the bytes as they are
        .write.option("lineSep", RECORD_END.decode())
        .option("maxRecordsPerFile", file_records)
        .text(path)
    )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(VERSION, at):
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at + len(VERSION) : end].decode().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start, size = end + 4, int(headers["content-length"])
        at = start + size + len(RECORD_END)
        if data[start + size : at] != RECORD_END:
            raise ValueError(f"the record that begins at byte {start} isn't as long as it says")
        yield headers, data[start : start + size]


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, without its transfer framing."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("an HTTP message without an end of its header")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def checked_payload(block: bytes, digest: str) -> bytes:
    payload = payload_of(block)
    if base32_sha1(payload) != digest:
        raise ValueError(f"the payload doesn't have the digest {digest}")
    return payload


def reassemble(numbers: list[int], blocks: list[bytes], total: int | None) -> bytes:
    """Join segments, given in the order of their numbers, and check that none is missing."""
    if numbers != list(range(1, len(numbers) + 1)) or total is None:
        raise ValueError(f"segments {numbers} of a record don't follow each other up to a last one")
    block = b"".join(blocks)
    if len(block) != total:
        raise ValueError(f"the segments of a record have {len(block)} bytes, not {total}")
    return block


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
RESULT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to and the payload.

    A revisit has no payload of its own; its length is that stated in its HTTP header. Records in
    one piece are decoded where they are read; only segments are shuffled.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    result_names = [c.split()[0] for c in RESULT.split(", ")]

    def headed(parts: Iterator[pa.RecordBatch], segmented: bool) -> Iterator[tuple]:
        """(headers, block, page_id, digest) of the records in one piece, or of the segments."""
        for part in parts:
            for content in part.column(0):
                for headers, block in parse(content.as_py()):
                    if ("warc-segment-number" in headers) == segmented:
                        page_id, digest = headers.get("x-page-id"), headers.get("warc-payload-digest")
                        yield headers, block, page_id and int(page_id), digest and digest.removeprefix("sha1:")

    def in_one_piece(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for headers, block, page_id, digest in headed(parts, False):
            if headers["warc-type"] == "response":
                payload = checked_payload(block, digest)
                yield page_id, len(payload), digest, "response", None, payload if with_payload else None
            elif headers["warc-type"] == "revisit":
                lines = (line.lower().split(b":", 1) for line in block.split(b"\r\n") if b":" in line)
                size = next(int(value) for key, value in lines if key == b"content-length")
                yield page_id, size, digest, "revisit", int(headers["x-refers-to-page-id"]), None

    def in_segments(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for headers, block, page_id, digest in headed(parts, True):
            origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
            total = headers.get("warc-segment-total-length")
            yield origin, int(headers["warc-segment-number"]), total and int(total), page_id, digest, block

    segment_names = ["origin", "number", "total", "page_id", "payload_digest", "block"]
    segment_types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    # The files are read twice: once for what is complete, once for the segments that must meet.
    direct = files.mapInArrow(lambda parts: batches(in_one_piece(parts), result_names, RESULT_TYPES, 512), RESULT)
    read = files.mapInArrow(
        lambda parts: batches(in_segments(parts), segment_names, segment_types, 256),
        "origin string, number int, total long, page_id long, payload_digest string, block binary",
    )

    # Equal pages have equal segments: counted, not repeated. A record's segments are as long as one page.
    segments = (
        read.groupBy(*segment_names)
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("number", "total", "page_id", "payload_digest", "copies", "block"))).alias("parts")
        )
        .select("parts")
    )

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for one in part.column(0):
                own = one.as_py()
                block = reassemble([p["number"] for p in own], [p["block"] for p in own], own[-1]["total"])
                first, digest = own[0], own[0]["payload_digest"]
                payload = checked_payload(block, digest)
                for _ in range(first["copies"]):
                    yield first["page_id"], len(payload), digest, "response", None, payload if with_payload else None

    joined = segments.mapInArrow(lambda parts: batches(whole(parts), result_names, RESULT_TYPES, 128), RESULT)
    out = direct.unionByName(joined)
    return out if with_payload else out.drop("payload")


#: What the archives must give back, for DuckDB; a digest is eight times five hex digits as four letters.
ORACLE = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS f FROM hashed)
SELECT page_id, strlen(body) AS payload_bytes,
  array_to_string(list_transform(list_transform(range(8), lambda i: cast('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)),
    lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15 & 31) + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10 & 31) + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5 & 31) + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM first
"""
