"""WARC records: reading them, and resolving not-modified revisits against the latest earlier full response."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import open_store

#: Headers that a 304 answer may renew in the response it confirms.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not choose a page.
TRACKING = r"([?&])(?:ref|utm_[a-z]+)=[^&]*"
#: Ticks of capture time that are searched together.
SPAN = 65_536
#: Bytes of a block that are skipped at a time.
_SKIP = 1 << 20
_RECORD = "record_id string, url string, at long, kind string, status int, headers map<string,string>"


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header lines as a map with lower-case names; a name that comes again has its values joined by commas."""
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _ticks(date: str | None) -> int | None:
    try:
        return int(datetime.fromisoformat(date).timestamp() * 1000)
    except (TypeError, ValueError):
        return None


def _http(stream: io.BufferedIOBase, left: int) -> tuple[int, list[bytes]]:
    """(bytes of the block left, lines of its HTTP message to its blank line, however long); no lines where the block is no HTTP message."""
    start = stream.read(min(5, left))
    left -= len(start)
    if start != b"HTTP/":
        return left, []
    lines, line = [], b""
    while left > 0:
        line = stream.readline(left)
        left -= len(line)
        if not line or not line.rstrip(b"\r\n"):
            break
        lines.append(line.rstrip(b"\r\n"))
    return left, [start + b"".join(lines[:1]), *lines[1:]]


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """(record_id, url, at, kind, status, headers) of each response and revisit of a WARC stream, one block at a time.

    at is the capture's millisecond, null where the record has none; headers are those of
    the HTTP message, read to its blank line. A block that is no HTTP message has no status
    and no headers, a missing id or URL is null. A record that the end of the stream cuts
    off is left out; anything but a WARC record is a ValueError.
    """
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line)
        about = _fields(lines)
        left, http = int(about.get("content-length", 0)), []
        if about.get("warc-type") in ("response", "revisit"):
            left, http = _http(stream, left)
        while left > 0 and (skipped := len(stream.read(min(left, _SKIP)))):
            left -= skipped
        if not line or left > 0:
            return
        if about.get("warc-type") not in ("response", "revisit"):
            continue
        code = http[0].split(b" ")[1:2] if http else []
        status = int(code[0]) if code and code[0].isdigit() else None
        url = about.get("warc-target-uri")
        yield about.get("warc-record-id"), url and url.strip("<>"), _ticks(about.get("warc-date")), about["warc-type"], status, _fields(http[1:])


def read_warc(spark: SparkSession, path: str, batch: int = 1000) -> DataFrame:
    """records, as resolve_revisits() takes them, of WARC files, plain or of gzip members; one task reads a file as a stream.

    An empty file, and a path without records, give no rows; nulls are those of warc_records().
    """
    files = spark.read.format("binaryFile").load(path).select("path")  # names only, no contents
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())]
    names = [x.split()[0] for x in _RECORD.replace("map<string,string>", "map").split(", ")]

    def run(batches):
        for some in batches:
            for name in some.column(0).to_pylist():
                fs, at = open_store(name)
                with fs.open_input_stream(at, compression=None) as raw:
                    whole = io.BufferedReader(raw)
                    found = []
                    for r in warc_records(gzip.GzipFile(fileobj=whole) if whole.peek(2)[:2] == b"\x1f\x8b" else whole):
                        found.append((*r[:5], list(r[5].items())))
                        if len(found) == batch:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)
                            found = []
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    return files.repartitionByRange(max(1, files.count()), "path").mapInArrow(run, _RECORD)  # by hash, some tasks would get several files


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host in lower case, no fragment, port, tracking parameters or last slash."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^https?://(www[.])?", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(u, "^[^/?]*", 0), ":(80|443)$", ""))
    rest = F.regexp_replace(F.regexp_replace(u, "^[^/?]*", ""), TRACKING, "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "[?]&", "?"), "[?&]$", "")
    return F.concat(host, F.regexp_replace(rest, "/$", ""))


def header(headers: Column, name: str) -> Column:
    return F.element_at(headers, F.lit(name))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """Each revisit with the response it stands for.

    records has record_id, url, at (capture time in ticks), kind ("response" or
    "revisit"), status and headers (a map with lower-case names). A revisit is joined, as
    of its time, to the latest earlier record of its canonical URL that is a full
    response (kind response, status 200); of those at one time the greatest record_id.
    It is resolved if the entity tags of both agree by weak comparison, or, where the
    revisit has none, their last-modified dates. The resolved headers are the
    response's, renewed by those of the revisit that a 304 may renew (RENEWED).

    Returns record_id, response_id, resolved, reason and headers (null if unresolved).
    A URL's records are searched by spans of time: within a span in order, and before it
    by the last response of each earlier span, so that a hot URL is split over tasks.

    Null url or time: reason "no earlier response". Repeated revisits each get a row;
    null headers count as none. An empty table gives no rows. Other columns are ignored.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("url"), "at", "kind", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    # records without a url or a time get far spans of their own, so that they do not meet in one task
    stray = F.pmod(F.xxhash64("record_id"), F.lit(1 << 20)) - F.lit(1 << 62)
    r = r.withColumn("span", F.when(F.col("url").isNull() | F.col("at").isNull(), stray).otherwise(F.floor(F.col("at") / span)))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    r = r.where(full | (F.col("kind") == "revisit")).withColumn("full", full)
    own = F.struct("at", "record_id", "headers")
    order = Window.partitionBy("url", "span").orderBy("at", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(F.when(F.col("full") & F.col("url").isNotNull() & F.col("at").isNotNull(), own), ignorenulls=True).over(order)
    seen = r.withColumn("inside", inside).where("not full")
    ends = r.where("url is not null and at is not null").groupBy("url", "span").agg(F.max_by(F.when(F.col("full"), own), F.when(F.col("full"), F.struct("at", "record_id"))).alias("end"))
    before = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("url", "span", F.last("end", ignorenulls=True).over(before).alias("before"))
    out = seen.join(ends, ["url", "span"], "left").withColumn("base", F.coalesce("inside", "before"))
    tag, base_tag = header(F.col("headers"), "etag"), header(F.col("base.headers"), "etag")
    changed, base_changed = header(F.col("headers"), "last-modified"), header(F.col("base.headers"), "last-modified")
    by_tag, by_date = F.coalesce(_strong(tag) == _strong(base_tag), F.lit(False)), F.coalesce(changed == base_changed, F.lit(False))
    reason = F.when(F.col("base").isNull(), "no earlier response").when(tag.isNotNull(), F.when(by_tag, "etag").otherwise("etag differs")).when(changed.isNotNull(), F.when(by_date, "last-modified").otherwise("last-modified differs")).otherwise("no validator")
    resolved = reason.isin("etag", "last-modified")
    renewed = F.map_filter("headers", lambda k, v: k.isin(*RENEWED))
    merged = F.map_concat(F.map_filter("base.headers", lambda k, v: ~F.map_contains_key(renewed, k)), renewed)
    return out.select("record_id", F.when(resolved, F.col("base.record_id")).alias("response_id"), resolved.alias("resolved"), reason.alias("reason"), F.when(resolved, merged).alias("headers"))


def header_text(headers: Column) -> Column:
    """Headers as lines in the order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def page_records(pages: DataFrame, again: int = 1000) -> DataFrame:
    """Captures made of a table of pages: each page as a response and, `again` pages later, as a 304 revisit.

    Time is twice the page id for responses and odd for revisits. The entity tag is a
    digest of the page, weak in the revisit of odd ids; every fifth page has only a
    last-modified date. Revisits whose URL had other content captured meanwhile will not
    match the then latest response.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    dated = F.col("page_id") % 5 == 0
    day = F.concat(F.lit("day "), (F.length(F.coalesce("html", F.lit(""))) % 97).cast("string"))
    first = F.map_from_arrays(F.array(F.lit("content-length"), F.lit("content-type"), F.lit("date"), F.when(dated, "last-modified").otherwise("etag")), F.array(F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("text/html"), (F.col("page_id") * 2).cast("string"), F.when(dated, day).otherwise(tag)))
    later = F.map_from_arrays(F.array(F.lit("content-type"), F.lit("date"), F.lit("cache-control"), F.when(dated, "last-modified").otherwise("etag")), F.array(F.lit("text/plain"), (F.col("page_id") * 2 + 2 * again + 1).cast("string"), F.lit("max-age=60"), F.when(dated, day).otherwise(F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("W/"), tag)).otherwise(tag))))
    one = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 2).alias("at"), F.lit("response").alias("kind"), F.lit(200).alias("status"), first.alias("headers"))
    two = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 2 + 2 * again + 1).alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), later.alias("headers"))
    return one.union(two)
