"""WARC: archives written with Spark's text sink, and a salvage reader.

Writing is native: each record is one string value whose last line end is the sink's row
separator, so the files are plain WARC files of bounded size, on whatever storage Spark writes
to. The reader also takes archives of gzip members.

The reader checks each record's header, length, closing blank lines and payload digest. After
a failed check it searches for the next gzip member or version line that passes them, goes on
from there, and logs the bytes between as a quarantined gap.

Defined cases: a null payload is empty; a null url leaves out the target; null and repeated
page ids are written as any other, and a record whose group has no non-null id is a response.
An empty table gives empty archives and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waneline.llm import text as T

REVISIT_BYTES = 1000
#: Records of up to so many payload bytes go so many to a file: no file passes 256 MB but for a single larger record.
FILE_TIERS = ((1 << 18, 1000), (1 << 24, 16), (None, 1))
#: Groups of equal payloads up to this number (some 100 bytes each) are broadcast; more are joined by a salted shuffle.
BROADCAST_ROWS = 100_000
SALTS = 32
_VERSION = re.compile(rb"(?:\A|(?<=\n))WARC/1\.[01]\r\n|\x1f\x8b\x08")


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    payload: bytes = field(repr=False)


@dataclass
class Gap:
    """Bytes [start, end) of the archive that no valid record covers."""

    start: int
    end: int


def parse(data: bytes, at: int) -> Record | None:
    """The record that begins at ``at``, or None if any check fails."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        return None
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    headers = {}
    for line in data[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in headers:
        return None
    body, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[body:end]
    if headers.get("content-type", "").startswith("application/http"):
        _, _, block = block.partition(b"\r\n\r\n")
    digest = headers.get("warc-payload-digest", "")
    if headers["warc-type"] != "revisit" and digest.startswith("sha1:") and hashlib.sha1(block).hexdigest() != digest[5:].lower():
        return None
    return Record(at, end + 4, headers, block)


def _member(data: bytes, at: int) -> tuple[list[Record], int] | None:
    """Records of the gzip member at ``at`` and where it ends, or None if it is damaged."""
    inflate = zlib.decompressobj(31)
    try:
        raw = inflate.decompress(memoryview(data)[at:])
    except zlib.error:
        return None
    if not inflate.eof:
        return None
    end = len(data) - len(inflate.unused_data)
    records = list(salvage(raw))
    return None if not records or any(isinstance(r, Gap) for r in records) else ([Record(at, end, r.headers, r.payload) for r in records], end)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Every valid record of an archive in order, and the gaps between them."""
    at, broken = 0, None
    while at < len(data):
        found: tuple[list[Record], int] | None
        if data.startswith(b"\x1f\x8b\x08", at):
            found = _member(data, at)
        else:
            record = parse(data, at)
            found = ([record], record.end) if record else None
        if found:
            if broken is not None:
                yield Gap(broken, at)
                broken = None
            yield from found[0]
            at = found[1]
            continue
        broken = at if broken is None else broken
        after = _VERSION.search(data, at + 1)
        at = after.start() if after else len(data)
    if broken is not None:
        yield Gap(broken, len(data))


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    return gzip.compress(record, mtime=0)


def classify(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each page.

    Equal payloads are counted by digest before anything is shuffled; only digests of two pages
    or more are joined back, by broadcast if they are few, else salted.
    """
    plain = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    plain = plain.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    groups = T.written(
        plain.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _response is not null").drop("_n")
    )
    if groups.count() <= BROADCAST_ROWS:
        joined = plain.join(F.broadcast(groups), "payload_digest", "left")
    else:
        spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = plain.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["payload_digest", "_salt"], "left").drop("_salt")
    again = F.col("_response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_response"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_response")).alias("refers_to")
    )


def record_text(date: str = "1970-01-01T00:00:00Z") -> Column:
    """A whole record but for its last line feed, from the columns of ``classify``."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    revisit = F.col("record_type") == "revisit"
    body = F.concat(F.lit(http), F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", ident("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", ident("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit("\r\n\r"),
    )


def write(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Write a record per page into plain WARC files under ``path``, in a folder for each tier of sizes that occurs."""
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    rows, below = classify(pages, least), 0
    for k, (most, records) in enumerate(FILE_TIERS):
        if k and longest < below:
            break
        size = F.col("payload_bytes")
        mine = rows.filter((size >= below) & (size < most)) if most else rows.filter(size >= below)
        mine.select(record_text().alias("value")).write.option("maxRecordsPerFile", records).text(f"{path}/tier={k}")
        below = most


_FIELDS = [("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())]


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, and per gap (record_type ``gap``), of all archives under ``path``, with byte spans; gaps are logged as warnings too."""
    schema = pa.schema(_FIELDS)

    def number(s: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", s or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                rows = []
                for r in salvage(content.as_py()):
                    if isinstance(r, Gap):
                        logging.getLogger(__name__).warning("quarantined bytes %d to %d of %s", r.start, r.end, name.as_py())
                        rows.append((name.as_py(), r.start, r.end, None, None, None, "gap", None, None))
                        continue
                    h, revisit = r.headers, r.headers["warc-type"] == "revisit"
                    digest = h.get("warc-payload-digest", "")[5:] if revisit else hashlib.sha1(r.payload).hexdigest()
                    size = h.get("x-payload-length", "") if revisit else str(len(r.payload))
                    rows.append((name.as_py(), r.start, r.end, number(h.get("warc-record-id")), int(size) if size.isdigit() else None, digest, h["warc-type"], number(h.get("warc-refers-to")), h.get("warc-target-uri")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, start long, end long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` to archives and read the archives back; a gap in what was just written is an error."""
    path = T.shared_dir(spark)
    write(T.table(spark, sf_dir, "pages"), path)
    whole = F.when(F.col("record_type") != "gap", True).otherwise(F.raise_error(F.concat(F.lit("damaged archive "), F.col("archive"))).cast("boolean"))
    return read(spark, path).filter(whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
ORACLES = {
    "op6_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), g AS (
  SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.response IS NOT NULL AND d.page_id IS DISTINCT FROM g.response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id IS DISTINCT FROM g.response THEN g.response END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000
"""
}
