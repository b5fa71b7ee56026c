"""WARC archives as chunked record tables.

A payload is cut into chunks of bounded size while its SHA-1 runs over them, so a chunk row carries the digest of all
bytes so far and the last one that of the payload. Chunks become WARC records: the first a response, the others
continuation records of the standard's record segmentation, so a reader never needs a whole payload in one piece
either. Archives are written by Spark as text with CRLF ends, and read back by splitting at the version line; a chunk
is cut so that it never holds that line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm.shared import BROADCAST_IDS, numbered, ship
from telemill.plans.storage import scratch_path, store

VERSION = "WARC/1.1\r\n"
#: Bytes of a chunk at most.
CHUNK = 256 << 10
#: Payloads below this size are always written in full.
REVISIT_FROM = 1000

_MARK = VERSION.encode()


def cut(payload: memoryview, size: int) -> Iterator[memoryview]:
    """Chunks of at most ``size`` bytes, at least one, cut between characters and inside any version line."""
    a, n = 0, len(payload)
    while True:
        b = min(a + size, n)
        while a + 4 < b < n and payload[b] & 0xC0 == 0x80:
            b -= 1
        at = bytes(payload[a : min(b + len(_MARK), n)]).find(_MARK)
        if at >= 0 and a + at + 2 < b + 2:
            b = a + at + 2
        yield payload[a:b]
        a = b
        if a >= n:
            return


def _chunks(size: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for record, row, uri, html in zip(*batch.columns, strict=True):
                record, row, uri, sha, done = record.as_py(), row.as_py(), uri.as_py(), hashlib.sha1(), 0
                payload = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                for k, chunk in enumerate(cut(payload, size)):
                    sha.update(chunk)
                    done += len(chunk)
                    held += len(chunk)
                    rows.append((record, row, uri, k, bytes(chunk), done, sha.hexdigest(), done == len(payload)))
                    if held >= 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            yield _batch(rows)

    return chunks


_CHUNK = pa.schema([("record_id", pa.int64()), ("row", pa.int64()), ("uri", pa.string()), ("chunk", pa.int32()), ("bytes", pa.binary()), ("done", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_CHUNK)], schema=_CHUNK)


def chunk_table(pages: DataFrame, size: int = CHUNK, row: str | None = None) -> DataFrame:
    """Chunks of (page_id, url, html): record_id, row, uri, chunk (from 0), bytes, done and digest (SHA-1 hex) of all bytes so far, last.

    A null or empty html has one empty chunk. A record's key is (record_id, row); ``row`` names a column of numbers that
    tell rows of one page_id apart (see numbered) and may be left out where page_id is unique. One pass, no shuffle; a batch of rows is given on after 4 MB.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), (F.col(row) if row else F.lit(0)).cast("long"), F.col("url"), F.col("html"))
    return rows.mapInArrow(_chunks(size), "record_id long, row long, uri string, chunk int, bytes binary, done long, digest string, last boolean")


def revisits(chunks: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """(record_id, row, refers_to, refers_row) of records of which an equal payload of at least ``least`` bytes has a larger id, the largest being referred to; a null id is below all others."""
    whole = chunks.filter("last").filter(F.col("done") >= least).select("record_id", "row", "digest", "done")
    kept = whole.groupBy("digest", "done").agg(F.max(F.struct("record_id", (-F.col("row")).alias("row"))).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    kept = kept.select("digest", "done", F.col("kept.record_id").alias("refers_to"), (-F.col("kept.row")).alias("refers_row"))
    again = whole.join(kept, ["digest", "done"]).filter("refers_to IS NOT NULL AND (record_id IS NULL OR record_id < refers_to)")
    return again.select("record_id", "row", "refers_to", "refers_row")


def _line(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def _urn(record: Column, row: Column, chunk: Column | int = 0) -> Column:
    """The name of a chunk's record; a null id is written as ``-``."""
    return F.format_string("<urn:page:%s:%d:%d>", F.coalesce(record.cast("string"), F.lit("-")), row, F.lit(chunk) if isinstance(chunk, int) else chunk)


def write_archive(chunks: DataFrame, again: DataFrame, path: str, compression: str = "none") -> None:
    """Write chunk rows as WARC records below ``path``, one file for each task; records in ``again`` (from revisits) without their payload.

    The list of revisits is broadcast up to BROADCAST_IDS rows, else it is joined by a shuffle.
    """
    again = store(again.select(F.col("record_id").alias("own_id"), F.col("row").alias("own_row"), "refers_to", "refers_row"), "revisits")
    same = F.col("record_id").eqNullSafe(F.col("own_id")) & (F.col("row") == F.col("own_row"))
    rows = chunks.join(F.broadcast(again) if again.count() <= BROADCAST_IDS else again, same, "left")
    revisit = F.col("refers_to").isNotNull()
    rows = rows.filter(~revisit | F.col("last"))
    first, last = revisit | (F.col("chunk") == 0), F.col("last")
    body = F.when(revisit, F.lit("")).otherwise(F.decode("bytes", "UTF-8"))
    none = F.lit("")
    segmented = ~revisit & ~((F.col("chunk") == 0) & last)
    uri = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]", " ")
    record = F.concat(
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").when(first, "response").otherwise("continuation"), F.lit("\r\n")),
        _line("WARC-Record-ID", _urn(F.col("record_id"), F.col("row"), F.when(revisit, F.lit(0)).otherwise(F.col("chunk")))),
        _line("WARC-Date", "1970-01-01T00:00:00Z"),
        _line("WARC-Target-URI", uri),
        F.when(revisit, _line("WARC-Refers-To", _urn(F.col("refers_to"), F.col("refers_row")))).otherwise(none),
        F.when(revisit, _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(none),
        F.when(segmented, _line("WARC-Segment-Number", F.col("chunk") + 1)).otherwise(none),
        F.when(segmented & ~first, _line("WARC-Segment-Origin-ID", _urn(F.col("record_id"), F.col("row")))).otherwise(none),
        F.when(segmented & last, _line("WARC-Segment-Total-Length", F.col("done"))).otherwise(none),
        F.when(last, _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))).otherwise(none),
        F.when(revisit, _line("X-Payload-Length", F.col("done"))).otherwise(none),
        _line("Content-Type", "text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")),
        body,
        F.lit("\r\n"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", compression).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Record rows of archives: record_id, row, chunk, type, uri, refers_to, payload_bytes and payload_digest (as headed), bytes, intact (the block has its Content-Length)."""
    text = spark.read.option("lineSep", VERSION).text(path).filter("value <> ''")
    head = F.substring_index("value", "\r\n\r\n", 1)
    block = F.expr("substring(value, length(head) + 5, length(value) - length(head) - 8)")
    rows = text.withColumn("head", head).withColumn("block", block)

    def get(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))

    def part(name: str, k: int) -> Column:
        """A part of a name that _urn made; null for ``-``."""
        return F.regexp_extract(get(name), r"^<urn:page:(-|-?\d+):(\d+):(\d+)>$", k).try_cast("long")

    return rows.select(
        part("WARC-Record-ID", 1).alias("record_id"),
        part("WARC-Record-ID", 2).alias("row"),
        part("WARC-Record-ID", 3).cast("int").alias("chunk"),
        get("WARC-Type").alias("type"),
        get("WARC-Target-URI").alias("uri"),
        part("WARC-Refers-To", 1).alias("refers_to"),
        F.coalesce(get("WARC-Segment-Total-Length"), get("X-Payload-Length")).cast("long").alias("payload_bytes"),
        F.substring_index(get("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        F.col("block").cast("binary").alias("bytes"),
        (F.octet_length("block") == get("Content-Length").cast("int")).alias("intact"),
        get("WARC-Segment-Number").isNotNull().alias("segmented"),
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (record_id, row, chunk): digest and length of each record, one chunk in memory at a time."""
    now, sha, n, head = None, None, 0, ""
    for batch in batches:
        out = []
        for record, row, data, digest in zip(*batch.columns, strict=True):
            key = (record.as_py(), row.as_py())
            if key != now:
                if now is not None:
                    out.append((now[0], n, sha.hexdigest(), head))
                now, sha, n, head = key, hashlib.sha1(), 0, ""
            part = data.as_buffer()
            sha.update(part)
            n += len(part)
            head = digest.as_py() or head
        yield _totals(out)
    if now is not None:
        yield _totals([(now[0], n, sha.hexdigest(), head)])


def _totals(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["record_id", "payload_bytes", "payload_digest", "headed"])


def payloads(records: DataFrame) -> DataFrame:
    """One row per archived record: record_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    Records in one piece are digested where they are read; only segmented ones are brought together, by record and
    in order of their chunks. A revisit has the figures of its header. verified: blocks and digest agree with the headers.
    """
    one = records.filter("NOT segmented")
    whole = one.select(
        "record_id",
        F.when(F.col("type") == "revisit", F.col("payload_bytes")).otherwise(F.octet_length("bytes")).cast("long").alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.col("payload_digest")).otherwise(F.sha1("bytes")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
        (F.col("intact") & ((F.col("type") == "revisit") | (F.sha1("bytes") == F.col("payload_digest")))).alias("verified"),
    )
    parts = records.filter("segmented").repartition("record_id", "row").sortWithinPartitions("record_id", "row", "chunk")
    many = parts.select("record_id", "row", "bytes", "payload_digest").mapInArrow(_joined, "record_id long, payload_bytes long, payload_digest string, headed string")
    many = many.select("record_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), (F.col("headed") == F.col("payload_digest")).alias("verified"))
    return whole.unionByName(many)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write a WARC record per page, read the archives back and describe each record.

    pages has (page_id, url, html); other columns are ignored, page_id names the record. Of records with equal payloads
    (UTF-8 of html; null: empty) of at least REVISIT_FROM bytes, the one with the largest page_id is a response and the
    others revisit it. Returns page_id, payload_bytes, payload_digest, record_type, refers_to, verified. Archives are
    written below ``path``, or in the shared folder. An empty table gives an empty result. Repeated rows are repeated
    records: where a page_id occurs twice, pages are numbered (and so written) first, and the number is part of each
    record's name. A null page_id counts as the smallest.
    """
    spark = pages.sparkSession
    if pages.groupBy("page_id").count().filter("count > 1").isEmpty():
        chunks = chunk_table(pages)
    else:
        chunks = chunk_table(numbered(pages, "page_id", "url", "html"), row="row")
    path = path or scratch_path(spark, "warc")
    write_archive(chunks, revisits(chunks.drop("bytes")), path)
    return payloads(read_archive(spark, path)).withColumnRenamed("record_id", "page_id")
