import gzip

import pytest
from pyspark.sql import functions as F

from tideline.llm.warc import canonical_url, header_text, read_warc, resolve_revisits

SCHEMA = "record_id long, url string, at long, kind string, status int, headers map<string,string>, base string, span int, full boolean"


def run(spark, records, **k):
    df = spark.createDataFrame([(*r, "x", 1, None) for r in records], SCHEMA)
    return {r.record_id: r for r in resolve_revisits(df, **k).collect()}


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_latest_earlier_response(spark, span):
    u = "http://www.A.example/p"
    e = lambda x, **k: {"etag": f'"{x}"', **k}
    got = run(spark, [
        (1, u, 5, "response", 200, e("a", **{"content-type": "text/html", "date": "1"})),
        (2, "https://a.example/p/#top", 9, "revisit", 304, {"etag": 'W/"a"', "date": "9", "content-type": "no"}),
        (3, u, 20, "response", 404, e("z")),
        (4, u, 30, "revisit", 304, e("a")),
        (5, u, 31, "response", 200, e("b")),
        (6, u + "?ref=x", 32, "revisit", 304, e("a")),
        (7, u, 5, "revisit", 304, e("a")),
        (8, u, 40, "response", 200, {"last-modified": "d"}),
        (9, u, 41, "revisit", 304, {"last-modified": "d"}),
        (10, u, 41, "revisit", 304, {"last-modified": "e"}),
        (11, u, 42, "revisit", 304, None),
        (12, None, 43, "revisit", 304, e("a")),
        (13, u, None, "revisit", 304, e("a")),
        (14, "http://b.example", 90, "revisit", 304, e("a")),
        (14, "http://b.example", 90, "revisit", 304, e("a")),
    ], span=span)
    assert {i: (r.response_id, r.reason) for i, r in got.items()} == {2: (1, "etag"), 4: (1, "etag"), 6: (None, "etag differs"), 7: (None, "no earlier response"), 9: (8, "last-modified"), 10: (None, "last-modified differs"), 11: (None, "no validator"), 12: (None, "no earlier response"), 13: (None, "no earlier response"), 14: (None, "no earlier response")}
    assert got[2].headers == {"etag": 'W/"a"', "date": "9", "content-type": "text/html"}
    assert got[6].headers is None and not got[6].resolved


def test_empty(spark):
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_canonical_url(spark):
    urls = {"HTTP://WWW.Example.org:80/A/?utm_source=x&b=1#f": "example.org/A/?b=1", "https://example.org/": "example.org", "http://example.org?ref=1": "example.org", "https://m.example.org/a?b=1&ref=z&c=2": "m.example.org/a?b=1&c=2"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == urls


def test_header_text(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"},)], "h map<string,string>")
    assert df.select(header_text(F.col("h")).alias("t")).first().t == "a: 1\nb: 2"


def record(kind, i, url, date, http=b"", end=b"\r\n\r\n"):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + end


def test_files_are_read_and_resolved(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nCache-Control: private\r\nCache-Control: max-age=1\r\nX-Odd\r\n\r\n" + b"WARC/1.1 in a body\r\n\r\n" * 3
    same = b"HTTP/1.1 304 Not Modified\r\nEtag: W/\"a\"\r\nDate: later\r\n\r\n"
    one = [record("warcinfo", 0, "", "2024-01-01T00:00:00Z", b"software: x\r\n"), record("response", 1, "<http://www.a.org/x>", "2024-01-01T00:00:01Z", page), record("request", 2, "http://a.org/x", "2024-01-01T00:00:01Z", b"GET / HTTP/1.1\r\n\r\n")]
    two = [record("revisit", 3, "https://a.org/x#f", "2024-01-02T00:00:00Z", same), record("response", 4, "http://b.org/", "no date", b"x" * 3_000_000), record("revisit", 5, "http://b.org", "2024-01-02T00:00:00Z")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.warc").write_bytes(b"".join(one) + record("response", 9, "http://a.org/x", "2024-01-01T12:00:00Z", page)[:-60])
    (tmp_path / "w" / "two.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in two))
    (tmp_path / "w" / "none.warc").write_bytes(b"")
    df = read_warc(spark, str(tmp_path / "w"), batch=2)
    rows = {r.record_id: r for r in df.collect()}
    assert rows.keys() == {f"<urn:{i}>" for i in (1, 3, 4, 5)}  # the cut record is left out
    r = rows["<urn:1>"]
    assert (r.url, r.at, r.kind, r.status, r.headers) == ("http://www.a.org/x", 1704067201000, "response", 200, {"etag": '"a"', "cache-control": "private, max-age=1"})
    assert (rows["<urn:4>"].at, rows["<urn:4>"].status, rows["<urn:5>"].headers) == (None, None, {})
    got = {r.record_id: r for r in resolve_revisits(df).collect()}
    assert (got["<urn:3>"].response_id, got["<urn:3>"].reason) == ("<urn:1>", "etag")
    assert got["<urn:3>"].headers == {"etag": 'W/"a"', "cache-control": "private, max-age=1", "date": "later"}
    assert (got["<urn:5>"].response_id, got["<urn:5>"].reason) == (None, "no earlier response")
    (tmp_path / "w" / "bad.warc").write_bytes(b"<html>")
    with pytest.raises(Exception, match="not a WARC record"):
        read_warc(spark, str(tmp_path / "w")).collect()


def test_long_headers_and_many_files(spark, tmp_path):
    """Headers of over a megabyte are read whole, a block that is no HTTP message has none, and each file has a task."""
    many = b"HTTP/1.1 200 OK\r\n" + b"".join(b"X-%d: %s\r\n" % (i, b"v" * 90) for i in range(20_000)) + b"ETag: \"last\"\r\n\r\nbody: not a header\r\n"
    for i in range(12):
        (tmp_path / f"{i}.warc").write_bytes(record("response", i, f"http://a.org/{i}", "2024-01-01T00:00:01Z", many if i == 3 else b"name: value\n\n" if i == 4 else b"HTTP/1.0 204\n" if i == 5 else b""))
    df = read_warc(spark, str(tmp_path))
    rows = {r.record_id: r for r in df.withColumn("task", F.spark_partition_id()).collect()}
    assert len(rows) == 12 and len({r.task for r in rows.values()}) == 12
    r = rows["<urn:3>"]
    assert len(r.headers) == 20_001 and r.headers["etag"] == '"last"' and r.headers["x-19999"] == "v" * 90 and "body" not in r.headers
    assert [(rows[f"<urn:{i}>"].status, rows[f"<urn:{i}>"].headers) for i in (4, 5, 6)] == [(None, {}), (204, {}), (None, {})]
    # columns of the names that are used inside
    extra = df.withColumns({c: F.lit("!") for c in ("tick", "slot", "b", "base", "u", "canonical", "span", "reason2")})
    assert resolve_revisits(extra).count() == 0
