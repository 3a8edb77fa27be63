"""Converts legacy ARC archives to WARC records.

An ARC file is a sequence of records, each a header line, a body of the declared length and a
line feed. Its first record, ``filedesc://``, describes the file: the first line of its body has the
version, the second one names the fields of all header lines, which differ by version:

* version 1: ``URL IP-address Archive-date Content-type Archive-length``
* version 2: ``URL IP-address Archive-date Content-type Result-code Checksum Location
  Offset Filename Archive-length``

A field that the second line leaves out is missing from the header lines too, and only the last one is
needed. URLs may hold spaces, so header lines are split from the right.

Of each record a WARC record is made: ``warcinfo`` of the description, ``response``
where the body is an HTTP response, ``metadata`` of other text and ``resource`` of anything
else. Its identifier is derived from file, offset and URL, so that converting again, or
a retry after a lost executor, gives the same one. Its date comes from the 14-digit (or shorter)
archive date. Digests are SHA-1 in base 32: of the block, and for HTTP responses of
the payload after the blank line.

Files are split over tasks as whole records can't be found from within; gzip members
are read one after the other. A body is cut by its declared length only, whatever it contains.

Defined results: a null or empty file has no records; a file without ``filedesc``
is read as version 1; a header line that can't be parsed, or a body shorter than declared,
gives an ``error`` instead of a type, and reading goes on at the next line that parses,
so nothing is skipped silently; an invalid date is null; repeated records differ in offset and keep their own
identifiers, repeated files have the same. No two records tie, as each has its own place. A body may be as long as its file, which is a row: of 2 GB at most, as
Spark reads files. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.common import table

V1 = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2 = (*V1[:4], "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")
SCHEMA = (
    "file string, offset bigint, arc_version int, warc_type string, record_id string, target_uri string, ip string, warc_date timestamp_ntz, "
    "content_type string, content_length bigint, block_digest string, payload_digest string, block binary, error string"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_STATUS = re.compile(rb"HTTP/\d")
_BLANK = re.compile(rb"\r?\n\r?\n")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(file: str, offset: int, url: str) -> str:
    """A name-based identifier: the same for the same place in the same file."""
    h = hashlib.sha1(f"{file}|{offset}|{url}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def parse_date(digits: str) -> datetime | None:
    """A date of 4 to 14 digits; what is left out is the earliest."""
    if not digits.isascii() or not digits.isdigit() or not 4 <= len(digits) <= 14 or len(digits) % 2:
        return None
    try:
        return datetime.strptime(digits + "00000101000000"[len(digits) :], "%Y%m%d%H%M%S")
    except ValueError:
        return None


def parse_header(line: bytes, fields: tuple[str, ...]) -> dict[str, str] | None:
    """The fields of a header line, or None if it isn't one."""
    parts = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(fields) - 1)
    if len(parts) != len(fields) or not parts[0] or not parts[-1].isascii() or not parts[-1].isdigit() or ":" not in parts[0]:
        return None
    return dict(zip(fields, parts))


def unzip(data: bytes) -> bytes:
    """All gzip members, one after the other; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def _fields_of(body: bytes) -> tuple[int, tuple[str, ...]]:
    """The version and header fields that a ``filedesc`` body declares."""
    lines = body.split(b"\n")
    version = 2 if lines[0][:1] == b"2" else 1
    named = tuple(lines[1].decode("utf-8", "replace").split()) if len(lines) > 1 else ()
    return version, named if named and named[0] == "URL" and named[-1] == "Archive-length" else (V2 if version == 2 else V1)


def convert(file: str, data: bytes | None) -> Iterator[tuple]:
    """The WARC records of an ARC file, in order, as rows of ``SCHEMA``."""
    data = unzip(data or b"")
    version, fields, at = 1, V1, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        described = line.startswith(b"filedesc:")
        # a description's own fields aren't known yet: the version is right that puts the date in its place
        tries = (V2, V1) if described else (fields,)
        heads = [h for f in tries if (h := parse_header(line, f))]
        head = next((h for h in heads if parse_date(h.get("Archive-date", ""))), heads[-1] if heads else None)
        if head is None:
            yield (file, at, version, None, None, None, None, None, None, None, None, None, line, "header")
            at = end + 1
            continue
        size = int(head["Archive-length"])
        body = data[end + 1 : end + 1 + size]
        url = head["URL"]
        if len(body) < size:
            yield (file, at, version, None, None, url, None, None, None, size, None, None, body, "length")
            at = end + 1
            continue
        kind = head.get("Content-type", "")
        payload = None
        if described:
            version, fields = _fields_of(body)
            form, mime = "warcinfo", "application/warc-fields"
        elif _STATUS.match(body):
            blank = _BLANK.search(body)
            payload = digest(body[blank.end() :] if blank else b"")
            form, mime = "response", "application/http; msgtype=response"
        else:
            form, mime = ("metadata" if kind.startswith("text/") and url.startswith("metadata:") else "resource"), kind or "application/octet-stream"
        ip = head.get("IP-address", "")
        ip = None if ip in ("", "0.0.0.0", "-") else ip
        uri = None if described else url
        yield (file, at, version, form, record_id(file, at, url), uri, ip, parse_date(head.get("Archive-date", "")), mime, size, digest(body), payload, body, None)
        at = end + 1 + size


def _convert_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows, size = [], 0
        for file, content in zip(pdf["file"], pdf["content"]):
            for row in convert(file or "", content):
                rows.append(row)
                size += len(row[12])
                if size > 8 << 20:  # a long archive goes out in several batches
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)


def arc_to_warc(files: DataFrame, name: Column | None = None, content: Column | None = None) -> DataFrame:
    """WARC records, as ``SCHEMA``, of ARC files given as rows of (path, content)."""
    known = files.select((F.col("path") if name is None else name).cast("string").alias("file"), (F.col("content") if content is None else content).alias("content"))
    return known.where("content IS NOT NULL").mapInPandas(_convert_batches, SCHEMA)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """WARC records of all ``.arc`` and ``.arc.gz`` files under ``path``."""
    return arc_to_warc(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.arc{,.gz}").load(path))


def warc_text(records: DataFrame) -> Column:
    """Each record as it stands in a WARC file."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", records["warc_type"]), line("WARC-Record-ID", records["record_id"]),
        line("WARC-Date", F.date_format("warc_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Target-URI", records["target_uri"]),
        line("WARC-IP-Address", records["ip"]), line("WARC-Block-Digest", records["block_digest"]), line("WARC-Payload-Digest", records["payload_digest"]),
        line("Content-Type", records["content_type"]), line("Content-Length", records["content_length"]), F.lit("\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), records["block"], F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def pages_as_arc(pages: DataFrame) -> DataFrame:
    """Each page as an ARC file of two records, version 1 for even page_ids and 2 for odd ones.

    A page without URL is archived as ``about:blank``, one without HTML with an empty body; pages without page_id are left out.
    """
    known = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.nullif("url", F.lit("")), F.lit("about:blank")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).where("page_id IS NOT NULL")
    body = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), "html"), "UTF-8")
    date = F.date_format(F.expr("timestampadd(SECOND, page_id, timestamp_ntz'2001-01-01 00:00:00')"), "yyyyMMddHHmmss")
    odd = F.expr("pmod(page_id, 2) = 1")
    ip = F.expr("concat('10.0.', pmod(page_id div 250, 250), '.', 1 + pmod(page_id, 250))")
    tail = F.when(odd, F.concat(F.lit(" 200 "), F.md5("html"), F.lit(" - 0 crawl.arc "))).otherwise(" ")
    descriptions = []
    for fields, first, more in ((V1, "1 0 crawler", ""), (V2, "2 0 crawler", " 200 - - 0 crawl.arc")):
        text = f"{first}\n{' '.join(fields)}\n\n"
        descriptions.append(f"filedesc://crawl.arc 0.0.0.0 20010101000000 text/plain{more} {len(text)}\n{text}\n")
    head = F.concat(F.when(odd, descriptions[1]).otherwise(descriptions[0]), "url", F.lit(" "), ip, F.lit(" "), date, F.lit(" text/html"), tail, F.octet_length(body), F.lit("\n"))
    return known.select(F.concat(F.lit("page-"), "page_id").alias("path"), F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\n"), "UTF-8")).alias("content"))


def op1_warc_arc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived as ARC and converted; blocks as text."""
    found = arc_to_warc(pages_as_arc(table(spark, sf_dir, "pages")))
    return found.withColumn("block", F.decode("block", "UTF-8"))


def _oracle() -> str:
    """The expected records, from the pages themselves."""
    def base32(x: str) -> str:
        five = f"(('0x' || substr(sha1({x}), 1 + (5 * i) // 4, 2))::INT >> (3 - (5 * i) % 4)) & 31"
        return f"'sha1:' || array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ({five}), 1) FOR i IN range(32)], '')"

    uuid = "'<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] || '>'"
    texts = [f"{first}\n{' '.join(fields)}\n\n" for fields, first in ((V1, "1 0 crawler"), (V2, "2 0 crawler"))]
    heads = [f"filedesc://crawl.arc 0.0.0.0 20010101000000 text/plain{more} {len(t)}\n" for t, more in zip(texts, ("", " 200 - - 0 crawl.arc"))]
    starts = [len(h) + len(t) + 1 for h, t in zip(heads, texts)]
    sql = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    http = "'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || chr(13) || chr(10) || html"
    return f"""
WITH p AS (SELECT page_id, 'page-' || page_id AS file, page_id % 2 + 1 AS v, url, html FROM pages),
r AS (
  SELECT file, 0 AS "offset", v, 'warcinfo' AS t, sha1(file || '|0|filedesc://crawl.arc') AS h, NULL AS uri, NULL AS ip, TIMESTAMP '2001-01-01' AS d,
         'application/warc-fields' AS c, CASE v WHEN 1 THEN {sql(texts[0])} ELSE {sql(texts[1])} END AS b, NULL AS payload FROM p
  UNION ALL
  SELECT file, CASE v WHEN 1 THEN {starts[0]} ELSE {starts[1]} END, v, 'response', sha1(file || '|' || CASE v WHEN 1 THEN {starts[0]} ELSE {starts[1]} END || '|' || url), url,
         '10.0.' || (page_id // 250) % 250 || '.' || 1 + page_id % 250, TIMESTAMP '2001-01-01' + to_seconds(page_id), 'application/http; msgtype=response', {http}, {base32('html')} FROM p)
SELECT file, "offset"::BIGINT AS "offset", v::INT AS arc_version, t AS warc_type, {uuid} AS record_id, uri AS target_uri, ip, d AS warc_date, c AS content_type,
       strlen(b)::BIGINT AS content_length, {base32('b')} AS block_digest, payload AS payload_digest, b AS block, NULL::VARCHAR AS error
FROM r
"""


ORACLE_OP1 = _oracle()
