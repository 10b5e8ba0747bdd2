"""WARC archives: a distributed writer, and a reader that salvages damaged files.

*Writing.*  A record is one string column: version line, headers, payload.  Spark's text writer puts
CR LF CR LF after each, so a folder of text files is a folder of valid archives, written by the
cluster's file committer to whatever store it uses.  Payloads that occur again (equal digest, at
least ``revisit_from`` bytes) are stored once; the others are ``revisit`` records.

*Reading.*  Files are read whole (the writer bounds their size; Spark's reader refuses one of over
2 GB) and parsed in Python in time that grows with their size.  A record has to pass every check: version
line, header syntax, length, the CR LF CR LF after the block, payload length and digest.  After a failed check the reader searches for the next version line or gzip member,
whichever comes first, whose record passes, resumes there, and logs the bytes between as a
quarantined gap.

Defined results
---------------
* null payload: a response of 0 bytes; null id: written as ``null``, read back as null
* equal ids with equal payloads: all rows are kept; all that hold the largest id are responses
* empty table: no records, no gaps
* damaged input: never an error; every byte is in a record or in a logged gap
* other columns are not read
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path, ship, staged

CRLF = "\r\n"
#: Payloads of fewer bytes are always stored.
REVISIT_FROM = 1000
#: Bytes of payload that one archive is meant to hold.
ARCHIVE_BYTES = 16 << 20
#: Repeated digests up to this number are broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000

ID_URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- writing


def _urn(page: Column) -> Column:
    return F.concat(F.lit(f"<{ID_URN}"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, id_col: str, url_col: str | None, payload_col: str, date: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """``(record, bytes)``: one WARC record for each row, as text without the closing blank lines."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    url = F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "") if url_col else F.lit(None)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.coalesce(url, F.lit("about:blank")).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    # Digests that occur again.  If they are few the payloads need no shuffle; else both sides
    # of the join are plain tables, so a hot digest can be split.
    first = staged(
        rows.where(F.col("n") >= revisit_from)
        .groupBy("digest", "n")
        .agg(F.max("page").alias("holder"), F.count(F.lit(1)).alias("k"))
        .where("k > 1")
        .select("digest", F.col("n").alias("_n"), "holder"),
        "repeated",
    )
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    again = (F.col("n") == F.col("_n")) & ~F.col("holder").eqNullSafe(F.col("page"))
    rows = rows.join(first, "digest", "left").withColumn("again", F.coalesce(again, F.lit(False)))
    body = F.when(F.col("again"), "").otherwise(F.col("payload"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("n").cast("string")),
        F.when(F.col("again"), F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("holder")))),
        F.when(F.col("again"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), body).alias("record"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str | None = "url",
    payload_col: str = "html",
    date: str = "2000-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
    revisit_from: int = REVISIT_FROM,
) -> str:
    """Write a folder of archives and return its path."""
    spark = pages.sparkSession
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(F.col(payload_col)), F.lit(0)) + 512)).first()[0] or 512
    out = records(pages, id_col, url_col, payload_col, date, revisit_from)
    most = max(1, int(archive_bytes / mean))
    out.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", most).text(path)
    spark.catalog.refreshByPath(path)
    return path


# ---------------------------------------------------------------- reading

Record = tuple[int, int, dict, bytes]  # first byte, byte after the last, headers, payload

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
#: Bytes of a gzip member that are inflated at a time.
MEMBER_CHUNK = 1 << 14
_HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)")


def parse_record(data: bytes, at: int) -> Record | str:
    """The record that begins at a byte, or why there is none."""
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    headers, start = {}, version.end()
    while True:  # header lines may be of any length and number; the first bad one ends the search
        end = data.find(b"\r\n", start)
        if end < 0:
            return "headers do not end"
        if end == start:
            break
        found = _HEADER.fullmatch(data, start, end)
        if not found:
            return "bad header line"
        headers[found[1].decode("ascii").lower()] = found[2].decode("utf-8", "replace")
        start = end + 2
    if not headers.get("content-length", "").isdecimal() or "warc-type" not in headers or "warc-record-id" not in headers:
        return "a required header is missing"
    start = end + 2
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "block does not end where its length says"
    payload = data[start:stop]
    if headers["warc-type"] != "revisit":
        if headers.get("x-payload-length", str(len(payload))) != str(len(payload)):
            return "payload length differs"
        if not _digest_holds(headers, payload):
            return "payload digest differs"
    return at, stop + 4, headers, payload


def _digest_holds(headers: dict, payload: bytes) -> bool:
    """True if no SHA-1 is given or it is that of the payload; HTTP heads are not part of it."""
    algorithm, _, value = headers.get("warc-payload-digest", "").partition(":")
    if algorithm.lower() != "sha1":
        return True
    if headers.get("content-type", "").startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha1(payload)
    return value.lower() in (digest.hexdigest(), base64.b32encode(digest.digest()).decode().lower())


def salvage(data: bytes, members: bool = True) -> Iterator[Record | tuple[int, int, str]]:
    """Records of an archive in order, and quarantined gaps as (first, after last, reason).

    Records stand plain or in gzip members, one after the other in any order; the records of a
    member all have its place.  ``members`` is False within a member.
    """
    at, bad, why = 0, None, ""
    line, magic = -1, -1  # the next places where a version line or a member may begin
    while at < len(data):
        found = _unit(data, at, members)
        if not isinstance(found, str):
            if bad is not None:
                yield bad, at, why
                bad = None
            yield from found
            at = found[0][1]
            continue
        if bad is None:
            bad, why = at, found
        if line <= at:
            version = _VERSION.search(data, at + 1)
            line = version.start() if version else len(data)
        if magic <= at:
            magic = data.find(_MAGIC, at + 1) if members else -1
            magic = len(data) if magic < 0 else magic
        at = min(line, magic)
    if bad is not None:
        yield bad, len(data), why


#: The reader finds out by itself what a file holds, whatever its first bytes are.
salvage_members = salvage


def _unit(data: bytes, at: int, members: bool) -> list | str:
    """What begins at a byte, a record or the contents of a gzip member, or why nothing does."""
    if not (members and data.startswith(_MAGIC, at)):
        found = parse_record(data, at)
        return found if isinstance(found, str) else [found]
    inner, size = _member(data, at)
    if inner is None:
        return "bad gzip member"
    found = list(salvage(inner, False))
    if not any(len(r) == 4 for r in found):
        return "member holds no record"
    good = [(at, at + size, r[2], r[3]) for r in found if len(r) == 4]
    return good + [(at, at + size, f"within a member: {r[2]}") for r in found if len(r) == 3]


def _member(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The contents and size of a gzip member, read in chunks: what follows it is not copied."""
    unzip, view, out, read = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not unzip.eof and read < len(data):
            out.append(unzip.decompress(view[read : read + MEMBER_CHUNK]))
            read = min(read + MEMBER_CHUNK, len(data))
    except zlib.error:
        return None, 0
    return (b"".join(out), read - at - len(unzip.unused_data)) if unzip.eof else (None, 0)


READ_SCHEMA = (
    "file string, first_byte long, after_byte long, gap string, record_type string, record_id string, refers_to string, "
    "target_uri string, digest string, payload_bytes long, payload binary"
)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record, and one with a reason in ``gap`` for each quarantined run of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, t) for n, t in zip(
            [c.split()[0] for c in READ_SCHEMA.split(", ")],
            [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()],
            strict=True,
        )])
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                name, data = file.as_py(), content.as_py()
                rows: list[tuple] = []
                held = 0
                for r in salvage(data):
                    if len(r) == 3:
                        rows.append((name, r[0], r[1], r[2], *[None] * 7))
                    else:
                        h = r[2]
                        size = h.get("x-payload-length", "") if h["warc-type"] == "revisit" else ""
                        digest = h.get("warc-payload-digest", "").partition(":")[2].lower() or None
                        rows.append((
                            name, r[0], r[1], None, h["warc-type"], h["warc-record-id"].strip("<>"),
                            h.get("warc-refers-to", "").strip("<>") or None, h.get("warc-target-uri"), digest,
                            int(size) if size.isdecimal() else len(r[3]), r[3] if with_payload else None,
                        ))
                        held += len(r[3])
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, READ_SCHEMA)


def page_of(urn: str) -> Column:
    """The page id in a record's name; null for ``null``."""
    return F.expr(f"try_cast(substring({urn}, {len(ID_URN) + 1}) AS BIGINT)")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = write_warc(pages, scratch_path(spark, "warc"))
    return pages_of(read_warc(spark, path, with_payload=False))


def pages_of(read: DataFrame) -> DataFrame:
    """The pages of archives that this process wrote: a gap in one of them is an error, not a lost page."""
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in an archive:"), "file", "first_byte", "after_byte", "gap"))
    return read.select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.when(F.col("gap").isNull(), F.col("record_type")).otherwise(lost).alias("record_type"),
        page_of("refers_to").alias("refers_to"),
    )


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages
), h AS (SELECT d, n, max(page_id) AS holder FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN coalesce(holder <> page_id, false) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN h ON p.d = h.d AND p.n = h.n
"""
