"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. Reader tasks scan byte ranges for gzip magic, validate a candidate by decoding the
WARC header that must follow, and own the records that start inside their range, reading on past its end where need be.

Null html is an empty payload, a null page_id is written as an absent header, rows that repeat id and payload are all
responses, an empty table gives an empty archive, and further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import rawfiles

#: Payloads of fewer bytes are never written as revisits.
LEAST_BYTES = 0
#: Bytes of a range that one task scans.
RANGE = 8 << 20
#: Copies of the digest table that a hot payload's pages are dealt over.
SALTS = 16
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: An empty gzip member: what the writer puts between records.
GAP = _gzip(b"")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: bool, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if response else head
    fields = [("WARC-Type", "response" if response else "revisit"), ("WARC-Date", DATE)]
    fields += [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("X-Page-Id", page_id)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    if not response:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Refers-To-Page", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return _gzip(text.encode() + block + b"\r\n\r\n")


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """A record for each of (page_id, url, html). Of equal payloads the one of the largest page_id is the response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", "html", F.unhex(F.sha1(html.cast("binary"))).alias("digest"), F.octet_length(html).alias("bytes"))
    shown = pages.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("shown"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shown = shown.select("digest", "shown", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(shown, ["digest", "salt"], "left")
    revisit = F.col("shown").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("shown")) & (F.col("bytes") >= least_bytes)
    rows = joined.select("page_id", "url", "html", "digest", revisit.alias("revisit"), "shown")

    def pack(batches):
        for batch in batches:
            out = []
            for page_id, url, html, digest, again, first in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "revisit", "shown")]):
                out.append(record(page_id, url, (html or "").encode(), base64.b32encode(digest).decode(), not again, first))
            yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})

    rawfiles.write(rows.mapInArrow(pack, "member binary"), "member", path, GAP)


#: Bytes that are decoded at a time, so that trying a candidate costs no more than its own length.
PIECE = 64 << 10


def _decoded(data: memoryview, at: int, more) -> tuple[bytes, int] | None:
    """The gzip member at `at` if it holds a WARC record, and the bytes it takes; `more` reads on behind `data`."""
    unpacker, parts, head, used = zlib.decompressobj(31), [], b"", 0
    piece = data[at : at + PIECE]
    try:
        while len(piece):
            parts.append(unpacker.decompress(piece))
            used += len(piece)
            if len(head) < 5:
                head = (head + parts[-1])[:5]
                if head != b"WARC/"[: len(head)]:
                    return None  # something else that looks like gzip
            if unpacker.eof:
                return (b"".join(parts), used - len(unpacker.unused_data)) if head == b"WARC/" else None
            piece = data[at + used : at + used + PIECE] if at + used < len(data) else more(PIECE)
    except zlib.error:
        pass
    return None


def _members(file: str, start: int, stop: int):
    """Decoded members that begin in [start, stop) and hold a WARC record."""
    with rawfiles.opened(file) as source:
        source.seek(start)
        data = source.read(stop - start + len(MAGIC) - 1)
        view, at = memoryview(data), data.find(MAGIC)
        while 0 <= at < stop - start:
            source.seek(start + len(data))
            found = _decoded(view, at, source.read)
            if found is not None:
                yield found[0]
            at = data.find(MAGIC, at + (found[1] if found is not None else 1))


def _parse(body: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def read(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Records of all archives of a folder: page_id, record_type, url, payload, payload_bytes, payload_digest, refers_to.

    A revisit has no payload of its own (null); its length and digest are those its header states.
    """
    names = ["page_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def scan(batches):
        for batch in batches:
            for file, start, stop in zip(*[batch.column(c).to_pylist() for c in ("file", "start", "stop")]):
                rows, held = [], 0
                for body in _members(file, start, stop):
                    fields, payload = _parse(body)
                    number = lambda k, f=fields: int(f[k]) if k in f else None
                    if fields["WARC-Type"] == "response":
                        found = (payload, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
                    else:
                        found = (None, number("X-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                    rows.append((number("X-Page-Id"), fields["WARC-Type"], fields.get("WARC-Target-URI"), *found, number("X-Refers-To-Page")))
                    held += len(payload)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return rawfiles.ranges(spark, path, size).mapInArrow(scan, "page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long")
