"""WARC archives: writing segmented records, and reassembly of what is read back.

A record whose block is longer than a segment is written as a first segment and
continuations. Reading groups continuations by the identifier of their origin, orders
them by segment number, verifies the total length and decodes chunked transfer framing.
"""

from __future__ import annotations

import base64
import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import scratch_path

#: Longest block of a record in bytes; longer ones are segmented.
SEGMENT_BYTES = 8192
#: Bytes of a chunk of the transfer framing.
CHUNK_BYTES = 4096
#: Payloads from this size on are stored once.
MIN_SHARED_BYTES = 1000
#: Records of an archive file: bounds what a reader holds at once.
RECORDS_PER_FILE = 2000
_EPOCH = "2024-01-01T00:00:00Z"


def record(kind: str, record_id: str, block: bytes, fields: dict[str, str]) -> bytes:
    """One WARC 1.1 record, with the blank lines that end it."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{record_id}>", "WARC-Date": _EPOCH} | fields | {"Content-Length": str(len(block))}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in HTTP chunked transfer coding."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(f"{len(p):x}\r\n".encode() + p + b"\r\n" for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer coding; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without an end")
        out.append(body[at : at + size])
        at += size + 2


def page_records(page_id: int, url: str, payload: bytes, sha1_hex: str, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES, row: int = 0) -> list[bytes]:
    """The records of a page: a revisit, a response, or a response in segments.

    Segments are told by the page and by ``row``, so a page that stands in a table twice keeps them apart.
    """
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    shared = {"WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest}
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        revisit = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
        return [record("revisit", str(page_id), head, shared | revisit)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [record("response", str(page_id), block, shared)]
    cuts = range(0, len(block), segment_bytes)
    out, origin = [], f"{page_id}/row/{row}"
    for number, at in enumerate(cuts, 1):
        fields = {"WARC-Segment-Number": str(number)}
        if number > 1:
            fields |= {"WARC-Segment-Origin-ID": f"<urn:page:{origin}>"}
        if number == len(cuts):
            fields |= {"WARC-Segment-Total-Length": str(len(block))}
        name = origin if number == 1 else f"{origin}/segment/{number}"
        out.append(record("response" if number == 1 else "continuation", name, block[at : at + segment_bytes], (shared if number == 1 else {}) | fields))
    return out


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``pages`` as gzip-compressed WARC files below ``path``, in parallel, through Spark's text writer.

    Of equal payloads of at least 1000 bytes the one with the largest id is stored, the
    others revisit it. A null payload is empty, a null URL an empty one, in which line
    breaks become blanks; rows with a null id have no identifier and are left out. Rows
    that repeat an id, alike or not, each have a record. A revisit names the page it refers to.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")).where("page_id IS NOT NULL").withColumn("sha1", F.sha1("payload"))
    large = F.octet_length("payload") >= MIN_SHARED_BYTES
    # one narrow row for each payload that stands at least twice; the wide side of the join
    # may be split where a payload is very common
    stored = rows.where(large).groupBy("sha1").agg(F.max("page_id").alias("stored_as"), F.count("*").alias("n")).where("n > 1").select("sha1", "stored_as")
    placed = rows.join(stored, "sha1", "left").select("page_id", "url", "payload", "sha1", F.when(large & (F.col("stored_as") != F.col("page_id")), F.col("stored_as")).alias("refers_to"), F.monotonically_increasing_id().alias("row"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for *page, row in zip(*[c.to_pylist() for c in batch.slice(start, 256).columns], strict=True):
                    out += page_records(*page, segment_bytes=segment_bytes, row=row)
                yield pa.record_batch([pa.array([x[:-1] for x in out], pa.binary())], ["value"])

    # the writer ends each value with the line feed that was cut off, so files hold records only
    placed.mapInArrow(framed, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", records_per_file).text(path, compression="gzip")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; ValueError where one is broken."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        at = start + int(fields["Content-Length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record that ends before byte {at}")
        yield fields, data[start:at]
        at += 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, kind, url, digest, refers_to, origin, segment, total, block)`` of all archives."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "kind", "url", "digest", "refers_to", "origin", "segment", "total", "block"]
        kinds = [*[pa.string()] * 6, pa.int32(), pa.int64(), pa.binary()]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

        for batch in batches:
            for data in batch.column(0):
                out, raw = [], data.as_buffer().to_pybytes()
                for f, block in parse_archive(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    number, total = f.get("WARC-Segment-Number"), f.get("WARC-Segment-Total-Length")
                    out.append((f["WARC-Record-ID"], f["WARC-Type"], f.get("WARC-Target-URI"), f.get("WARC-Payload-Digest"), f.get("WARC-Refers-To"), f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), int(number) if number else None, int(total) if total else None, block))
                    if len(out) == 256:
                        yield batch_of(out)
                        out = []
                yield batch_of(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parsed, "record_id string, kind string, url string, digest string, refers_to string, origin string, segment int, total long, block binary")


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: segments joined by origin, in order of their numbers.

    A missing segment or a length other than the total raises an error. Records without
    segments don't move. All segments of one record meet in one task: a record has to
    fit there anyway.
    """
    whole = records.where("segment IS NULL").select("record_id", "kind", "url", "digest", "refers_to", "block")
    parts = records.where("segment IS NOT NULL").groupBy(F.col("origin").alias("record_id")).agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "url", "digest", "refers_to")],
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
    )
    sound = F.expr("transform(parts, x -> x.segment) = sequence(1, size(parts)) AND aggregate(parts, 0L, (n, x) -> n + octet_length(x.block)) = total")
    block = F.expr("aggregate(parts, cast('' as binary), (b, x) -> concat(b, x.block))")
    checked = F.when(F.coalesce(sound, F.lit(False)), block).otherwise(F.raise_error(F.concat(F.lit("broken segments of "), F.col("record_id"))).cast("binary"))
    return whole.unionByName(parts.select("record_id", "kind", "url", "digest", "refers_to", checked.alias("block")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)``.

    The digest is bare lower-case hex. A response's payload is its body without transfer
    framing, whose digest must be that of its header. A revisit has no payload of its own:
    its length and digest are those its headers state, its payload is null.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        number = lambda urn: int(urn.removeprefix("<urn:page:").removesuffix(">").partition("/")[0]) if urn else None
        for batch in batches:
            out = []
            for record_id, kind, url, digest, refers_to, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                head, _, body = block.partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                sha1 = base64.b32decode(digest.removeprefix("sha1:")).hex()
                payload, size = None, fields.get("Content-Length")
                if kind == "response":
                    payload = unchunked(body) if fields.get("Transfer-Encoding") == "chunked" else body
                    size = len(payload)
                    if hashlib.sha1(payload).hexdigest() != sha1:
                        raise ValueError(f"payload of {record_id} isn't that of its digest")
                out.append((number(record_id), url, kind, number(refers_to), int(size), sha1, payload))
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    return reassembled(read_records(spark, path)).select("record_id", "kind", "url", "digest", "refers_to", "block").mapInArrow(decoded, schema)


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_pages(pages.sparkSession, path)
