"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

Everything is an expression over a table of responses, so derivation is a single pass without shuffle.
Record ids follow from the source record's id, so a rerun writes the same records. Files are read a whole one in
a task, record by record by their stated lengths, and written as text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import html_lines, sql_text

CRLF = "\r\n"
VERSION = "WARC/1.1"
RECORD = ("warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_payload_digest", "source_headers", "block")


def _uuid(seed: Column) -> Column:
    h = F.md5(seed)
    return F.concat(F.lit("urn:uuid:"), *(x for i, (at, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in (([F.lit("-")] if i else []) + [F.substring(h, at, n)])))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a (page_id, url, html) table, which keeps no fetch date: date stands for all.

    A null html is an empty body; a null url stays null; ids follow from page_id and url.
    """
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        _uuid(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))).alias("record_id"),
        F.lit(date).alias("warc_date"),
        F.col("url").alias("target_uri"),
        head.alias("http_headers"),
        body.alias("payload"),
    )


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each response: its metadata record and its conversion record.

    Both carry refers_to (the response's id), its target URI, date, HTTP headers and payload digest; the
    two name each other in concurrent_to. The metadata block lists title and links, the conversion block
    is the page's text. A null payload counts as empty. Repeated rows give repeated records; an empty
    table gives an empty one. A payload of any length is worked on as one value, some five times its size.
    keep names columns to carry along; one called like a column of the result gets underscores added.
    Line breaks and tabs in a link are left out, as browsers do.
    """
    carried = [f"carried_{c}" for c in keep]
    html = F.coalesce("payload", F.lit(""))
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    links = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
    base = responses.select(
        *(F.col(c).alias(n) for c, n in zip(keep, carried)),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("http_headers").alias("source_headers"),
        _digest(html).alias("source_payload_digest"),
        F.concat_ws("\n", F.concat(F.lit("title: "), title), F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"[\t\r\n]+", "")))).alias("fields"),
        html_lines(html).alias("plain"),
    )
    kinds = (("metadata", "application/warc-fields", "fields", "conversion"), ("conversion", "text/plain; charset=utf-8", "plain", "metadata"))
    rows = [F.struct(F.lit(kind).alias("warc_type"), F.lit(mime).alias("content_type"), F.lit(other).alias("other"), F.col(block).alias("block")) for kind, mime, block, other in kinds]
    each = base.withColumn("record", F.explode(F.array(*rows))).drop("fields", "plain")
    of = lambda kind: _uuid(F.concat_ws("|", kind, F.col("refers_to")))
    names = []
    for c in keep:
        while c.lower() in RECORD or c.lower() in names:
            c += "_"
        names.append(c.lower())
    return each.select(
        *(F.col(n).alias(c) for n, c in zip(carried, names)),
        "record.warc_type",
        of(F.col("record.warc_type")).alias("record_id"),
        "refers_to",
        of(F.col("record.other")).alias("concurrent_to"),
        "target_uri",
        "warc_date",
        "record.content_type",
        F.octet_length("record.block").cast("long").alias("content_length"),
        _digest(F.col("record.block")).alias("block_digest"),
        "source_payload_digest",
        "source_headers",
        "record.block",
    )


def serialized(records: DataFrame) -> Column:
    """A record as WARC text, up to the second line break after its block. Source HTTP headers go in as one folded field.

    A null field is left out; a line break within a field is a blank, so no value can end the header block.
    """
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    field = lambda name, c: F.concat(F.lit(f"{name}: "), one_line(c))
    head = F.concat_ws(
        CRLF,
        F.lit(VERSION),
        field("WARC-Type", F.col("warc_type")),
        field("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        field("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))),
        field("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("concurrent_to"), F.lit(">"))),
        field("WARC-Target-URI", F.col("target_uri")),
        field("WARC-Date", F.col("warc_date")),
        field("WARC-Block-Digest", F.col("block_digest")),
        field("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        field("WARC-Source-HTTP", F.replace(F.col("source_headers"), F.lit(CRLF), F.lit(" | "))),
        field("Content-Type", F.col("content_type")),
        field("Content-Length", F.col("content_length").cast("string")),
    )
    return F.concat(head, F.lit(CRLF + CRLF), F.col("block"), F.lit(CRLF))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    records.select(serialized(records).alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(path)


def _inflated(data: bytes) -> bytes:
    """data unpacked if it is gzip, all members of it; a file cut off in a member gives what can be read."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            out.append(z.decompress(data))
        except zlib.error:
            break
        if not z.eof:
            break
        data = z.unused_data.lstrip(b"\0")
    return b"".join(out)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers, block, whole) of each record: its block has as many bytes as Content-Length says, whatever stands in it.

    Where a length is missing or wrong, reading goes on at the next line that begins a record.
    """
    start = re.compile(rb"^WARC/[0-9]+\.[0-9]+\r?\n", re.M)
    at = start.search(data)
    while at:
        end = re.compile(rb"\r?\n\r?\n").search(data, at.end() - 2)
        lines = data[at.end() : end.start() if end else len(data)].decode("utf-8", "replace")
        headers: dict[str, str] = {}
        for line in re.sub(r"\r?\n[ \t]+", " ", lines).splitlines():
            name, _, value = line.partition(":")
            headers[name.strip()] = value.strip()
        first = end.end() if end else len(data)
        stated = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
        last = first + int(stated) if re.fullmatch(r"[0-9]{1,18}", stated) else -1
        after = re.compile(rb"(\r?\n){0,2}").match(data, max(last, 0))
        if 0 <= last <= len(data) and (after.end() == len(data) or start.match(data, after.end())):
            yield headers, data[first:last], True
            at = start.match(data, after.end())
        else:
            at = start.search(data, first)
            yield headers, data[first : at.start() if at else len(data)], False


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, headers, block, whole) of every record below path, block as bytes; plain files and gzip, versions 1.0 and 1.1.

    whole tells whether the record has its stated length and another one, or the end, follows. A task reads one file
    with all its bytes, packed and unpacked: crawls write files of about 1 GB, and Spark's reader takes 2 GB at most.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held, size = [], 0
                for record in _records(_inflated(content.as_py())):
                    held.append(record)
                    size += len(record[1])
                    if size >= 16 << 20:
                        yield rows(name, held)
                        held, size = [], 0
                yield rows(name, held)

    def rows(name, held):
        pairs = pa.array([list(h.items()) for h, _, _ in held], pa.map_(pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pairs, pa.array([b for _, b, _ in held], pa.binary()), pa.array([w for _, _, w in held], pa.bool_())], names=["file", "headers", "block", "whole"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, headers map<string,string>, block binary, whole boolean")


def responses(records: DataFrame) -> DataFrame:
    """What derive() needs of the response records among read_warc()'s rows, and their file.

    The payload is what follows the HTTP headers, as UTF-8 with replacement characters; a response without headers
    has none and is all payload. Records that aren't whole are derived from as far as they go. Header names count in
    any case. A missing id, date or URI is null.
    """

    def run(batches):
        for batch in batches:
            out = []
            for file, pairs, block in zip(batch.column("file").to_pylist(), batch.column("headers").to_pylist(), batch.column("block")):
                h = {k.lower(): v for k, v in pairs}
                if h.get("warc-type", "").lower() == "response":
                    http, body = None, block.as_py()
                    if body.startswith(b"HTTP/"):
                        http, _, body = body.partition(b"\r\n\r\n")
                    id_, uri = (x and x.strip("<>") for x in (h.get("warc-record-id"), h.get("warc-target-uri")))
                    out.append((file, id_, h.get("warc-date"), uri, http and http.decode("utf-8", "replace"), body.decode("utf-8", "replace")))
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    names = ["file", "record_id", "warc_date", "target_uri", "http_headers", "payload"]
    return records.select("file", "headers", "block").mapInArrow(run, ", ".join(f"{n} string" for n in names))


def page_derivatives(pages: DataFrame) -> DataFrame:
    return derive(responses_from_pages(pages), keep=("page_id",))


def _sql_uuid(seed: str) -> str:
    h = f"md5({seed})"
    return f"('urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"


ORACLE = rf"""
with r as (select page_id, url target_uri, {_sql_uuid("'response|' || coalesce(cast(page_id as varchar), '') || '|' || coalesce(url, '')")} refers_to, coalesce(html, '') html from pages),
a as (select *, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) title, regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) links from r),
{sql_text('html', 'a', 'page_id, target_uri, refers_to, html, title, links')},
d as (select *, x plain, unnest(['metadata', 'conversion']) warc_type from t5),
e as (select *, case when warc_type = 'metadata' then array_to_string(list_concat(['title: ' || title], list_transform(links, lambda l: 'outlink: ' || regexp_replace(l, '[\t\r\n]+', '', 'g'))), chr(10)) else plain end block,
 case when warc_type = 'metadata' then 'conversion' else 'metadata' end other from d)
select page_id, warc_type, {_sql_uuid("warc_type || '|' || refers_to")} record_id, refers_to, {_sql_uuid("other || '|' || refers_to")} concurrent_to, target_uri, '2024-01-01T00:00:00Z' warc_date,
 case when warc_type = 'metadata' then 'application/warc-fields' else 'text/plain; charset=utf-8' end content_type, cast(strlen(block) as bigint) content_length,
 'sha256:' || sha256(block) block_digest, 'sha256:' || sha256(html) source_payload_digest,
 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) source_headers, block from e
"""
