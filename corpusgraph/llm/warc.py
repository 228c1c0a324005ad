"""WARC captures: not-modified revisits get the latest earlier full response of their canonical URL.

`resolve` is the as-of join.  Only narrow columns travel: a body stays where it is and
is found by `source_seq`.  Captures are cut into time buckets (quantiles of the time):
inside (URL, bucket) a window finds the latest earlier response, and what a bucket
inherits is carried over one row for each (URL, bucket), so that one URL with a third of
all captures is dealt to as many tasks as there are buckets.

A revisit is `resolved` if a validator agrees (ETag, compared weakly; without one on
either side, Last-Modified), `changed` if it disagrees, `unvalidated` if there is none to
compare and `orphan` with no earlier response; a response is `full`.  A resolved revisit has
the response's headers, overwritten by its own of PERMITTED.

Defined cases: header names are folded to lower case; a null URL has no other capture of its page; null times sort first; equal
times are ordered by seq; null headers are no headers; bytes of a file that are no record are a row with `problem`; repeated captures stay rows; an
empty table gives an empty table; names of other columns don't matter, as they aren't read.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B

#: Headers that a 304 may update in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that say where a click came from, not which page it is.
TRACKING = "^(utm_[a-z]+|ref|sessionid|sid)="


def canonical_url(url: Column) -> Column:
    """Host and path in one form: no scheme, www, default port, fragment, tracking parameters, final slash; sorted parameters."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _folded(headers: Column) -> Column:
    """Headers with their names in lower case; of names that then are equal the value that sorts first stays."""
    lower = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.map_from_entries(F.filter(lower, lambda e, i: (i == 0) | (F.get(lower, i - 1)["key"] != e["key"])))


def resolve(captures: DataFrame) -> DataFrame:
    """Of captures(seq, url, ts, is_revisit, headers map<string,string>): a row each, with status, source_seq and headers."""
    rows = captures.select("seq", "url", "ts", F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"), _folded(F.col("headers")).alias("headers"))
    rows = rows.withColumn("url_key", F.coalesce(canonical_url(F.col("url")), F.concat(F.lit("\0"), F.coalesce(F.col("seq").cast("string"), F.lit("")))))
    blocks = max(B.MIN_BLOCKS, rows.count() // 50_000)
    rows = B.range_block(rows.withColumn("at", F.coalesce(F.col("ts").cast("double").cast("long"), F.lit(-(1 << 62)))), blocks, "at")
    response = F.when(~F.col("is_revisit"), F.struct("at", "seq", F.map_entries("headers").alias("headers")))
    order = [F.col("at"), F.col("seq")]
    here = Window.partitionBy("url_key", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local", F.last(response, ignorenulls=True).over(here))
    of_block = rows.where(~F.col("is_revisit")).groupBy("url_key", "block").agg(F.max(F.struct("at", "seq", F.map_entries("headers").alias("headers"))).alias("newest"))
    spots = rows.select("url_key", "block").distinct().join(of_block, ["url_key", "block"], "left")
    before = Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select("url_key", "block", F.last("newest", ignorenulls=True).over(before).alias("carried"))
    both = local.join(carried, ["url_key", "block"], "left").withColumn("source", F.when(F.col("is_revisit"), F.coalesce("local", "carried")))
    theirs = F.map_from_entries("source.headers")
    weak = lambda h: F.regexp_replace(h, "^W/", "")
    etag = weak(F.col("headers")["etag"]) == weak(theirs["etag"])
    same = F.coalesce(etag, F.col("headers")["last-modified"] == theirs["last-modified"])
    status = F.when(~F.col("is_revisit"), "full").when(F.col("source").isNull(), "orphan").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("changed")
    own = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
    return both.withColumn("status", status).select("seq", "url_key", "ts", "is_revisit", "status", F.when(F.col("status") == "resolved", F.col("source.seq")).alias("source_seq"), F.when(F.col("status") == "resolved", merged).otherwise(F.col("headers")).alias("headers"))


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def encode_record(kind: str, url: str, date: str, record_id: str, headers: dict[str, str], body: bytes = b"", status: int = 200) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member; members one after another are a .warc.gz file."""
    http = b"HTTP/1.1 %d %s\r\n" % (status, b"Not Modified" if status == 304 else b"OK") + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + body
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", url), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http)))]
    return gzip.compress(b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + http + b"\r\n\r\n", mtime=0)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


_MAGIC = b"\x1f\x8b\x08"
_PIECE = 1 << 16
_NEXT = re.compile(rb"(?:\A|\n)(?=WARC/[0-9])")


def _members(raw: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Gzip members, unpacked; of a broken one what could be unpacked, and what is wrong.  Reading goes on at the next member."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        start, out, unpack = at, [], zlib.decompressobj(31)
        try:
            while at < len(raw) and not unpack.eof:
                out.append(unpack.decompress(view[at : at + _PIECE]))
                at += _PIECE
            if unpack.eof:
                at = min(at, len(raw)) - len(unpack.unused_data)
                yield b"".join(out), None
                continue
            problem = "gzip member is cut off"
        except zlib.error:
            problem = "broken gzip member"
        yield b"".join(out), f"{problem} at byte {start}"
        following = raw.find(_MAGIC, start + 1)
        at = len(raw) if following < 0 else following


def _row(problem: str | None = None, **fields) -> dict:
    return dict.fromkeys(("kind", "record_id", "url", "date", "http_status", "headers", "body")) | fields | {"problem": problem}


def _parsed(text: bytes) -> Iterator[dict]:
    """Records of unpacked bytes; where none can be read, a row that says so, and on from the next line that opens one."""
    at = 0
    while at < len(text):
        while text[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(text):
            return
        problem = None
        if not text.startswith(b"WARC/", at):
            problem = "no record"
        else:
            ends = [(k, len(x)) for x in (b"\r\n\r\n", b"\n\n") if (k := text.find(x, at)) >= 0]
            end, gap = min(ends, default=(len(text), 0))
            warc = _fields(text[at:end].split(b"\n")[1:])
            length = warc.get("content-length", "0")
            if not length.isascii() or not length.isdigit():
                problem = "no content length"
            elif end + gap + int(length) > len(text):
                problem = "record is cut off"
        if problem:
            yield _row(f"{problem} at byte {at}")
            following = _NEXT.search(text, at + 1)
            if not following:
                return
            at = following.end()
            continue
        block = text[end + gap : end + gap + int(length)]
        at = end + gap + int(length)
        head, _, body = block.partition(b"\r\n\r\n")
        first, *rest = head.split(b"\r\n")
        status = first.split()[1:2] if first.startswith(b"HTTP/") else []
        number = int(status[0]) if status and re.fullmatch(rb"[0-9]{1,9}", status[0]) else None
        yield _row(kind=warc.get("warc-type"), record_id=warc.get("warc-record-id"), url=warc.get("warc-target-uri"), date=warc.get("warc-date"), http_status=number, headers=_fields(rest), body=body)


def decode_records(raw: bytes) -> Iterator[dict]:
    """Records of a .warc or .warc.gz file.  What can't be read is a row with `problem`, and what follows is read."""
    if raw[:2] != _MAGIC[:2]:
        yield from _parsed(raw)
        return
    for text, problem in _members(raw):
        yield from _parsed(text)
        if problem:
            yield _row(problem)


RECORD = "kind string, record_id string, url string, date string, http_status int, headers map<string,string>, body binary, problem string"
#: Records, and bytes of bodies, that a worker gathers before it hands them on.
BATCH_RECORDS, BATCH_BODIES = 256, 4 << 20


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files under a path, problems too; Spark's own reader opens them, a task a file, so a file must be under 2 GB."""
    import pandas as pd

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for record in decode_records(bytes(content)):
                    rows.append(record)
                    size += len(record["body"] or b"")
                    if len(rows) == BATCH_RECORDS or size > BATCH_BODIES:
                        yield pd.DataFrame(rows).astype({"http_status": "Int32"})
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows).astype({"http_status": "Int32"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORD)


def page_captures(pages: DataFrame) -> DataFrame:
    """A crawl told from pages: each page is a full capture, and each third one was asked for again a day later.

    Of those, each fifth answer names another ETag and each seventh none.
    """
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    quoted = F.concat(F.lit('"'), F.col("digest"), F.lit('"'))
    full = F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8"), F.lit("date"), F.col("page_id").cast("string"), F.lit("etag"), quoted, F.lit("server"), F.concat(F.lit("s"), (F.col("page_id") % 7).cast("string")), F.lit("cache-control"), F.concat(F.lit("max-age="), (F.col("page_id") % 5).cast("string")))
    again = F.create_map(F.lit("date"), (F.col("page_id") + 86400).cast("string"), F.lit("etag"), F.when(F.col("page_id") % 15 == 0, F.lit('"other"')).when(F.col("page_id") % 21 != 0, F.concat(F.lit("W/"), quoted)), F.lit("vary"), F.lit("accept"), F.lit("cache-control"), F.lit("max-age=0"), F.lit("server"), F.lit("edge"), F.lit("content-length"), F.lit("0"))
    again = F.map_filter(again, lambda _, v: v.isNotNull())
    one = F.struct((F.col("page_id") * 2).alias("seq"), F.col("page_id").alias("ts"), F.lit(False).alias("is_revisit"), full.alias("headers"))
    two = F.struct((F.col("page_id") * 2 + 1).alias("seq"), (F.col("page_id") + 86400).alias("ts"), F.lit(True).alias("is_revisit"), again.alias("headers"))
    return p.select("url", F.explode(F.when(F.col("page_id") % 3 == 0, F.array(one, two)).otherwise(F.array(one))).alias("c")).select("url", "c.*")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resolve(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return got.select("seq", "url_key", "status", "source_seq", header_text(F.col("headers")).alias("headers"))


OP10_SQL = """
WITH bare AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM pages
), parts AS (
  SELECT page_id, digest,
    regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*', 0)), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|sessionid|sid)='))) AS kept
  FROM bare
), p AS (
  SELECT page_id, digest, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key FROM parts
), a AS (
  SELECT page_id, url_key, digest, page_id + 86400 AS ts,
    CASE WHEN page_id % 15 = 0 THEN '"other"' WHEN page_id % 21 <> 0 THEN '"' || digest || '"' END AS etag
  FROM p WHERE page_id % 3 = 0
), m AS (
  SELECT a.*, s.page_id AS from_id, s.digest AS from_digest FROM a ASOF LEFT JOIN p s ON a.url_key = s.url_key AND a.ts >= s.page_id
)
SELECT page_id * 2 AS seq, url_key, 'full' AS status, CAST(NULL AS BIGINT) AS source_seq,
  'cache-control: max-age=' || page_id % 5 || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) || 'date: ' || page_id || chr(10) || 'etag: "' || digest || '"' || chr(10) || 'server: s' || page_id % 7 AS headers
FROM p
UNION ALL
SELECT page_id * 2 + 1, url_key, CASE WHEN from_id IS NULL THEN 'orphan' WHEN etag IS NULL THEN 'unvalidated' WHEN etag = '"' || from_digest || '"' THEN 'resolved' ELSE 'changed' END AS st,
  CASE WHEN etag = '"' || from_digest || '"' THEN from_id * 2 END,
  CASE WHEN etag = '"' || from_digest || '"'
    THEN 'cache-control: max-age=0' || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) || 'date: ' || ts || chr(10) || 'etag: W/' || etag || chr(10) || 'server: s' || from_id % 7 || chr(10) || 'vary: accept'
    ELSE 'cache-control: max-age=0' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts || coalesce(chr(10) || 'etag: ' || CASE WHEN etag = '"other"' THEN etag ELSE 'W/' || etag END, '') || chr(10) || 'server: edge' || chr(10) || 'vary: accept' END
FROM m
"""
