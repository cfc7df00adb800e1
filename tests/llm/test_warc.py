"""Derived records: links, digests, text, and a round trip through files."""

import base64
import hashlib
import tempfile

from pyspark.sql import functions as F

from statloom.llm.warc import derive, metadata, plain_text, read_warc, responses, write_warc

PAGE = """<!DOCTYPE html><html lang="FR"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- <p>no</p> --><nav><a href="/x?a=1&amp;b=2">x</a><a href='/x?a=1&amp;b=2'>again</a></nav><p>One <b>two</b>&nbsp;three<br>four</p><p>5 &lt; 6</p></body></html>"""


def test_text():
    assert plain_text(PAGE) == "xagain\nOne two three\nfour\n5 < 6"
    assert plain_text("") == "" and plain_text("<p") == "<p" and plain_text("a < b > c") == "a < b > c"
    assert plain_text("<script>never closed") == "" and plain_text("<!-- open") == ""
    assert len(plain_text("<" * 20_000 + "<p>x</p>" * 20_000)) > 20_000


def test_records(spark):
    d = spark.createDataFrame([(1, "http://a/", PAGE), (1, "http://a/", PAGE), (2, None, None), (None, "http://b/", "")], "page_id long, url string, html string").withColumn("block", F.lit(1))
    src = {(r["page_id"], r["target_uri"]): r for r in responses(d, "2024-01-01T00:00:00Z").collect()}
    rows = derive(responses(d, "2024-01-01T00:00:00Z")).collect()
    assert len(rows) == 8
    for r in rows:
        s = src[r["page_id"], r["target_uri"]]
        assert r["refers_to"] == s["record_id"] and r["source_headers"] == s["headers"]
        assert r["source_digest"] == "sha1:" + base64.b32encode(hashlib.sha1((s["payload"] or "").encode()).digest()).decode()
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"].encode()).digest()).decode() and r["length"] == len(r["block"].encode())
    meta = next(r["block"] for r in rows if r["page_id"] == 1 and r["record_type"] == "metadata")
    assert "title: A & B\r\n" in meta and "language: fr\r\n" in meta and meta.count("outlink: /x?a=1&b=2\r\n") == 1
    assert len({r["record_id"] for r in rows}) == 6
    path = tempfile.mkdtemp(prefix="spark-") + "/warc"
    write_warc(derive(responses(d, "2024-01-01T00:00:00Z")), path)
    back = read_warc(spark, path).collect()
    assert sorted((b["header"]["warc-record-id"], b["block"]) for b in back) == sorted((r["record_id"], r["block"]) for r in rows)


def test_empty(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    assert derive(responses(d, "2024-01-01T00:00:00Z")).collect() == []


def test_open_heads_and_comment_marks():
    page = "<html><head><meta charset=x><title>T <!-- t</title><noscript><img></noscript>{}<a href='/y'>y</a> end</html>"
    for rest, text in (("<body><p>One</p>", "One\ny end"), ("<p>One</p>", "One\ny end"), ("One ", "One y end"), ("</head>One ", "One y end")):
        assert plain_text(page.format(rest)) == text
        assert "title: T <!-- t\r\n" in metadata(page.format(rest), None, "") and "outlink: /y\r\n" in metadata(page.format(rest), None, "")
    assert plain_text("<script>var s = '<!-- ';</script>One<style>/* <!-- */</style> two") == "One two"
    assert plain_text("a<!-- <script> --> b<!-- </script> --> c") == "a b c"


def test_blocks_with_version_lines_and_repeated_headers(spark):
    """A title that looks like a record's start, source headers that stand twice: a written file gives all of it back."""
    page = "<title>WARC/1.1\r\nWARC-Type: no</title><p>a</p><pre>WARC/1.1\r\n\r\nb</pre>"
    rows = [(1, "http://a/", page, "HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2"), (2, "http://b/", "é" * 1000, None), (3, None, None, "X: \"WARC/1.1\"")]
    d = spark.createDataFrame(rows, "page_id long, target_uri string, payload string, headers string").withColumns({"record_id": F.concat(F.lit("<urn:"), F.col("page_id"), F.lit(">")), "date": F.lit("2024-01-01T00:00:00Z")})
    made = derive(d).coalesce(1)
    # A block that holds a whole record.
    made = made.withColumn("block", F.when((F.col("page_id") == 2) & (F.col("record_type") == "metadata"), F.lit("x\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\ny")).otherwise(F.col("block"))).withColumn("length", F.octet_length("block").cast("bigint"))
    path = tempfile.mkdtemp(prefix="spark-") + "/warc"
    write_warc(made, path)
    want = {(r["record_id"]): r for r in made.collect()}
    got = {r["header"]["warc-record-id"]: r for r in read_warc(spark, path).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r["block"] == want[k]["block"] and r["header"]["x-source-payload-digest"] == want[k]["source_digest"]
        lines = [h["value"] for h in r["headers"] if h["name"] == "X-Source-Header"]
        assert lines == [x for x in (want[k]["source_headers"] or "").split("\r\n") if x]
    write_warc(made.limit(0), path)
    assert read_warc(spark, path).collect() == []
