"""WARC derivatives: linked metadata and plain-text conversion records from response records.

A response has its record id, target URI, date, HTTP headers and payload. From each come a metadata record (title,
language, outgoing links, the source's headers and payload digest, as warc-fields) and a conversion record (the plain
text). Both refer to the response by WARC-Refers-To; ids follow from the source's id, so a rerun gives the same ones.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.frames import need
from .text import bounded

VERSION = "WARC/1.1"
SOURCE_HEADER, SOURCE_DIGEST = "X-Source-Header", "X-Source-Payload-Digest"      # extension fields of derived records
#: Elements whose content is no text, tags that may stand in a head, and elements that begin a new line.
HIDDEN = "noscript|template|iframe|svg"
IN_HEAD = "title|meta|link|base|basefont|bgsound"
BREAKING = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul"

# Comments, scripts and styles go in one pass, as the mark of one may stand inside another; so may a comment's in a title, which stays.
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)|(<(title|textarea)\b[^<>]*>.*?</\3\s*>)", re.S | re.I)
_HIDDEN = re.compile(rf"<({HIDDEN})\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
# </head> may be left out: a head ends before the first text or element that cannot stand in it.
_HEAD = re.compile(rf"<head\b[^<>]*>(?:\s+|<title\b[^<>]*>.*?</title\s*>|</?(?:{IN_HEAD})\b[^<>]*>|<[!?][^<>]*>)*+(?:</head\s*>)?", re.S | re.I)
_BREAK = re.compile(rf"</?(?:{BREAKING})\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^<>]*>")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)

FIELDS = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_headers string, source_digest string, block_digest string, length bigint, block string"


def digest(data: bytes) -> str:
    """A labelled digest as WARC writers give it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + ' ' + of)}>"


def _bare(page: str) -> str:
    return _RAW.sub(lambda m: m[2] or " ", page)


def _visible(bare: str) -> str:
    return _HEAD.sub(" ", _HIDDEN.sub(" ", bare))


def plain_text(page: str) -> str:
    """What a page shows as text: no markup, comments or hidden elements, entities decoded, one line per block."""
    t = _visible(_bare(page))
    t = entities.unescape(_TAG.sub("", _BREAK.sub("\n", t.replace("\n", " "))))
    return _LINES.sub("\n", _BLANK.sub(" ", t)).strip()


def _one_line(s: str) -> str:
    return " ".join(entities.unescape(_TAG.sub("", s)).split())


def metadata(page: str, headers: str | None, source_digest: str) -> str:
    """The warc-fields of a page; a null page has those of its source alone."""
    seen = _bare(page)
    out = [f"title: {_one_line(m[1])}"] if (m := _TITLE.search(seen)) else []
    out += [f"language: {m[1].lower()}"] if (m := _LANG.search(seen)) else []
    out += [f"source-header: {line}" for line in (headers or "").replace("\r", "").split("\n") if line.strip()]
    out.append(f"source-payload-digest: {source_digest}")
    out += [f"outlink: {_one_line(link)}" for link in dict.fromkeys(a or b or c for a, b, c in _LINK.findall(_visible(seen))) if link.strip()]
    return "\r\n".join(out) + "\r\n"


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a page table: page_id, record_id, target_uri, date, headers, payload.

    Ids come from url and page id; both may be null.
    """
    need(pages, id_col, url_col, html_col)
    h = F.sha1(F.concat_ws(" ", F.lit("response"), F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rid = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "$1-$2-5$3-a$4-$5"), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length(html_col), F.lit(0)).cast("string"))
    return pages.select(F.col(id_col).alias("page_id"), rid.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), F.col(html_col).alias("payload"))


def derive(source: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two records of every response, metadata and conversion, with the columns of FIELDS and those in `keep`.

    The source's headers and its payload digest go along with both. A null or empty payload gives an empty conversion
    and a metadata record all the same; a null URI or header stays null. Repeated rows give repeated records, with
    equal ids where the source's are equal. An empty table gives no rows.
    """
    need(source, *keep, "record_id", "target_uri", "date", "headers", "payload")
    d = source.select("payload", "record_id", "target_uri", "date", "headers", *keep)
    names = [*keep, *(f.split()[0] for f in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "payload"):
            rows = []
            for page, rid, uri, date, headers in zip(*(b.column(i).to_pylist() for i in range(5))):
                page = page or ""
                of, src = rid or "", digest(page.encode())
                for kind, ctype, block in (("metadata", "application/warc-fields", metadata(page, headers, src)), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
                    raw = block.encode("utf-8", "replace")
                    rows.append((kind, record_id(kind, of), rid, uri, date, ctype, headers, src, digest(raw), len(raw), raw.decode()))
            twice = pa.array([i // 2 for i in range(len(rows))], pa.int32())
            cols = [pa.array(c, pa.int64() if n == "length" else pa.string()) for n, c in zip(names[len(keep):], zip(*rows))]
            yield pa.RecordBatch.from_arrays([*(b.column(5 + i).take(twice) for i in range(len(keep))), *cols], names)

    kinds = "".join(f"{k} {source.schema[k].dataType.simpleString()}, " for k in keep)
    return d.mapInArrow(run, kinds + FIELDS)


def as_record() -> Column:
    """A derived record as WARC text, without the two line ends that close it.

    The source's headers go along as one field for each of their lines, its payload digest as another.
    """
    field = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    lines = F.filter(F.split(F.coalesce("source_headers", F.lit("")), "[\r\n]+"), lambda x: F.trim(x) != "")
    source = F.array_join(F.transform(lines, lambda x: F.concat(F.lit(f"{SOURCE_HEADER}: "), x, F.lit("\r\n"))), "")
    return F.concat(F.lit(f"{VERSION}\r\n"), field("WARC-Type", "record_type"), field("WARC-Record-ID", "record_id"), field("WARC-Refers-To", "refers_to"), field("WARC-Target-URI", "target_uri"), field("WARC-Date", "date"),
                    field("WARC-Block-Digest", "block_digest"), field(SOURCE_DIGEST, "source_digest"), source, field("Content-Type", "content_type"), field("Content-Length", "length"), F.lit("\r\n"), F.col("block"))


def write_warc(records: DataFrame, path: str) -> None:
    """One gzip file of records per partition; rows as in `derive`, an empty table writes no record."""
    records.select(as_record().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").mode("overwrite").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of gzipped WARC files: headers (array of name and value, in order), header (map by lower-case name) and block.

    A record is as long as its Content-Length says, whatever its block holds: files are cut at version lines, and a piece
    that is shorter goes on with the next ones. A header that stands more than once is kept as often in `headers`, and
    joined by ", " in `header`. A record without a length ends at the next version line. Bytes that are no UTF-8 are
    replaced. Empty files give no rows.
    """
    mark = f"{VERSION}\r\n"
    pieces = spark.read.option("lineSep", mark).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    fields = "headers array<struct<name:string,value:string>>, header map<string,string>, block string"
    schema = pa.schema([("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("header", pa.map_(pa.string(), pa.string())), ("block", pa.string())])

    def record(text: str):
        head, _, block = text.partition("\r\n\r\n")
        headers = [(k.strip(), v.strip()) for k, c, v in (line.partition(":") for line in head.split("\r\n")) if c]
        size = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit()), None)
        return headers, block, size

    def done(headers, block, size):
        raw = block.encode("utf-8", "replace")
        block = raw[:size].decode("utf-8", "replace") if size is not None else block.removesuffix("\r\n\r\n")
        by: dict[str, str] = {}
        for k, v in headers:
            by[k.lower()] = f"{by[k.lower()]}, {v}" if k.lower() in by else v
        return {"headers": [{"name": k, "value": v} for k, v in headers], "header": list(by.items()), "block": block}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now, headers, size, have = [], None, None, None, 0
        for b in bounded(batches, "value"):
            rows = []
            for text, file in zip(*(c.to_pylist() for c in b.columns)):
                if parts and file == now and size is not None and have < size:
                    parts.append(mark + text)
                    have += len((mark + text).encode("utf-8", "replace"))
                    continue
                if parts:
                    rows.append(done(headers, "".join(parts), size))
                    parts = []
                now = file
                if text and "\r\n\r\n" in text:
                    headers, block, size = record(text)
                    parts, have = [block], len(block.encode("utf-8", "replace"))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if parts:
            yield pa.RecordBatch.from_pylist([done(headers, "".join(parts), size)], schema=schema)

    return pieces.mapInArrow(run, fields)
