"""WARC archives with segmented, chunked records, and their reassembly.

A response of more than ``segment_bytes`` is written as a first record and continuation records, which name it
in WARC-Segment-Origin-ID; the last one states the whole length. Reading groups the records of an origin, orders
them by segment number, verifies the length, and takes the chunked transfer framing off the payload. Records that
are no segments are never grouped.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import batch_slices, drop_path, materialise, new_path, require_free

VERSION = b"WARC/1.1\r\n"
#: Payloads below this are never revisits.
MIN_REVISIT_BYTES = 1000
SEGMENT_BYTES, CHUNK_BYTES = 16 << 10, 4096
#: Records in a file; with SEGMENT_BYTES this bounds a file, which a reader holds whole.
RECORDS_PER_FILE = 512
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, url_col: str = "url") -> DataFrame:
    """The columns of pages with ``payload`` (null html: empty), its length and SHA-1, and ``refers_to``.

    Of rows with equal payloads of min_bytes at least, those with the largest id are responses and the others
    refer to it (``refers_url`` is its url); a null id never is the largest, and rows without any id are responses.
    Only digests that occur twice or more are joined, so no-copy tables join with next to nothing. Columns of pages
    that are called like one of the new ones are an error.
    """
    require_free(pages, "payload", "payload_bytes", "payload_digest", "refers_to", "refers_url")
    rows = pages.withColumn("payload", F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = rows.filter(F.col("payload_bytes") >= min_bytes)
    first = large.groupBy(F.col("payload_digest").alias("d")).agg(F.max(F.struct(id_col, url_col)).alias("first"), F.count(F.lit(1)).alias("copies"))
    # written first, so that the join has a shuffle of its own on both sides, whose large partitions Spark can split
    first = materialise(first.filter("copies > 1").select("d", F.col(f"first.{id_col}").alias("first_id"), F.col(f"first.{url_col}").alias("first_url")), "copies")
    at = (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") >= min_bytes)
    other = F.col("first_id").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("first_id"))
    marked = rows.join(first, at, "left").withColumn("refers_to", F.when(other, F.col("first_id"))).withColumn("refers_url", F.when(other, F.col("first_url")))
    return marked.drop("d", "first_id", "first_url")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload under chunked framing; ValueError if the framing is broken or cut off."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return VERSION + head.encode() + b"\r\n" + block


def _records(page_id, url, refers_to, refers_url, digest: str, uid: str, payload: bytes, segment_bytes: int) -> Iterator[bytes]:
    """A page's records, each without the two line ends that close it.

    A revisit names its response by target and date, and by page in a field of our own.
    """
    url, refers_url = ("".join(c for c in (u or "") if c > " ") or None for u in (url, refers_url))
    common = [("WARC-Record-ID", f"<urn:uuid:{uid}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", profile), ("WARC-Refers-To-Target-URI", refers_url), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", refers_to)], b"")
        return
    block = HTTP_HEAD + chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *common, kind], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), *common, kind, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        own = [("WARC-Record-ID", f"<urn:uuid:{uid}-{n}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url)]
        total = len(block) if n == len(parts) else None
        yield _record([("WARC-Type", "continuation"), *own, ("WARC-Segment-Origin-ID", f"<urn:uuid:{uid}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


def write_warc(marked: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, id_col: str = "page_id", url_col: str = "url") -> None:
    """Write rows of mark_revisits() as gzip-compressed WARC files under path, in any file system of Spark.

    Spark's text writer puts the records down: a record's closing line ends are the writer's line separator.
    A file is one gzip member. Every row gets records of its own, repeated rows and null ids too.
    """
    rows = marked.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col("refers_to").cast("long").alias("refers_to"), "refers_url", "payload_digest", F.expr("uuid()").alias("uid"), "payload")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "payload"):
            out = [r for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True) for r in _records(*row, segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive: by Content-Length, never by searching for the next version line."""
    at = 0
    urn = lambda v: v.strip("<>").removeprefix("urn:uuid:")
    whole = lambda v: int(v) if v is not None else None
    while at < len(data):
        if data[at : at + len(VERSION)] != VERSION:
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at + len(VERSION) : end].decode().split("\r\n"))
        block = data[end + 4 : end + 4 + (n := int(head["Content-Length"]))]
        if len(block) != n:
            raise ValueError("a record is cut off")
        at = end + 4 + n
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record is not closed")
        at += 4
        yield (
            urn(head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"])), whole(head.get("WARC-Segment-Number")), whole(head.get("WARC-Segment-Total-Length")),
            head["WARC-Type"], whole(head.get("X-Page-ID")), whole(head.get("X-Refers-To-Page-ID")), head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, block,
        )


def read_records(spark: SparkSession, path: str, segments: bool | None = None) -> DataFrame:
    """All records of the gzip-compressed archives under path, one row each; segment is null for whole records.

    segments: give only records that are segments, or only those that are none.
    """
    kind = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = [r for r in _parse(gzip.decompress(data.as_py())) if segments is None or segments == (r[1] is not None)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


_PAYLOAD = T.StructType([f for f in RECORD if f.name in ("record_type", "page_id", "refers_to", "digest")] + [T.StructField("payload", T.BinaryType())])


def _body(kind: str, block: bytes) -> bytes | None:
    return None if kind == "revisit" else unchunked(block[block.index(b"\r\n\r\n") + 4 :])


def whole_records(records: DataFrame) -> DataFrame:
    """record_type, page_id, refers_to, digest and payload of records that are no segments, without a shuffle."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [_body(k, b) for k, b in zip(batch.column("record_type").to_pylist(), batch.column("block").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PAYLOAD.names[:-1]), pa.array(payloads, pa.binary())], names=_PAYLOAD.names)

    return records.filter("segment is null").mapInArrow(open_, _PAYLOAD)


def reassemble(records: DataFrame) -> DataFrame:
    """The columns of whole_records, one row for each record that was cut into segments.

    A group holds one record's segments and no more. A gap in the numbers, a length other than the stated one, or
    broken framing fails the job: an archive that lost data must not look whole.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for kind, parts in zip(batch.column("record_type").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                parts.sort(key=lambda p: p["segment"])
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError("segments are missing or doubled")
                block = b"".join(p["block"] for p in parts)
                if parts[-1]["total"] != len(block):
                    raise ValueError("segments don't have the stated length")
                payloads.append(_body(kind, block))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PAYLOAD.names[:-1]), pa.array(payloads, pa.binary())], names=_PAYLOAD.names)

    head = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    parts = F.collect_list(F.struct("segment", "total", "block")).alias("parts")
    grouped = records.filter("segment is not null").groupBy("origin").agg(*(head(c) for c in _PAYLOAD.names[:-1]), parts).drop("origin")
    return grouped.mapInArrow(join, _PAYLOAD)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The columns of whole_records for every response and revisit under path. Archives are parsed twice, so that only
    segments are shuffled."""
    return whole_records(read_records(spark, path, False)).unionByName(reassemble(read_records(spark, path, True)))


def _measured(payloads: DataFrame) -> DataFrame:
    return payloads.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha"))


def archive_report(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages, read the archives back, and describe each page by what was read. Archives under a path of the
    caller's stay; others are deleted.

    A revisit's length and digest are those of the response it refers to, which must bear the digest that the
    revisit states; a revisit without such a response fails the job. Repeated rows each give a row, a null html is an
    empty payload, and an empty table gives no rows.
    """
    own = None if path else new_path(spark, "warc")
    path = path or own
    write_warc(mark_revisits(pages.select("page_id", "url", "html")), path)
    read = materialise(_measured(read_payloads(spark, path)), "warc-read")
    if own:
        drop_path(spark, own)
    whole = read.filter("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to")
    again = read.filter("record_type = 'revisit'").select("page_id", "digest", "record_type", "refers_to")
    target = whole.groupBy(F.col("page_id").alias("target"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    resolved = again.join(target, (F.col("refers_to") == F.col("target")) & (F.col("digest") == F.col("payload_digest")), "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    found = lambda c: F.when(F.col("target").isNull(), lost.cast(c[1])).otherwise(F.col(c[0])).alias(c[0])
    return whole.unionByName(resolved.select("page_id", found(("payload_bytes", "long")), found(("payload_digest", "string")), "record_type", "refers_to"))


#: The same rows in DuckDB.
ARCHIVE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AND payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AND payload_bytes >= 1000 THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
