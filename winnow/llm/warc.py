"""WARC derivative builder: metadata and plain-text conversion records of responses.

Every response gives one metadata record (type application/warc-fields) and one conversion
record (text/plain).  Both name the response, its URI and its date in their refers-to fields and
carry the digest of its payload; the metadata keeps the HTTP headers of the source and names the
conversion.  One narrow pass: nothing is shuffled.

`responses` makes response records of a page table, `warc_text` the bytes of records for a text
writer, `read_warc` reads files back.

Defined results: a null page is an empty payload, a null URI is empty; an empty payload gives an
empty conversion; an unclosed script or comment ends with the page; repeated rows give records of equal identifiers; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import map_slices, table
from winnow.llm.html_extract import OPEN_COMMENT, TOKEN
from winnow.llm.registry import query

DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = ("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8")

# fixed values: HTML element names
_INLINE = "a|abbr|b|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|u"
_RAW = "script|style|title|noscript|template"
_INLINE_NAMES, _RAW_NAMES = frozenset(_INLINE.split("|")), frozenset(_RAW.split("|"))


def plain_text(page: str) -> str:
    """All visible text of a page in order, with single spaces; one pass over the page.

    An element with raw text that is never closed ends with the page.
    """
    out, at, last = [], 0, page.rfind(">")
    while at < len(page):
        hit = (TOKEN if at <= last else OPEN_COMMENT).search(page, at)
        if hit is None:
            out.append(page[at:])
            break
        out.append(page[at:hit.start()])
        at = hit.end()
        tag = ((hit[2] or hit[5] or "") if hit.re is TOKEN else "").lower()
        if tag in _RAW_NAMES and not (hit[1] or hit[4]):
            done = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = done.end() if done else len(page)
        if tag not in _INLINE_NAMES:
            out.append(" ")
    return " ".join(html.unescape("".join(out)).split())


def _urn(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[
        F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record_id, target_uri, warc_date, http_headers, payload) of a page table."""
    page, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(F.lit("\r\n".join([*HTTP_HEAD, "Content-Length: "])),
                    F.octet_length(page).cast("string"), F.lit("\r\n"))
    return pages.select(
        "page_id", _urn("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url)
        .alias("record_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"),
        head.alias("http_headers"), page.alias("payload"))


def derive(records: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns and the two records of every response, one row each.

    ``records`` needs record_id, target_uri, warc_date, http_headers and payload.
    """
    used = ("record_id", "target_uri", "warc_date", "http_headers")
    given = records.select(*keep, *used, _digest(F.col("payload")).alias("source_digest"),
                           "payload")
    names = [*given.columns[:-1], "plain"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [plain_text(p or "") for p in batch.column(len(names) - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())],
                                          names=names)

    schema = T.StructType([*given.schema.fields[:-1], T.StructField("plain", T.StringType())])
    plain = map_slices(given, work, schema)
    conversion = _urn("conversion", F.col("record_id"))
    metadata = _urn("metadata", F.col("record_id"))
    fields = F.concat(
        F.lit("conversion: "), conversion, F.lit("\r\nsource-digest: "), F.col("source_digest"),
        F.lit("\r\ntext-digest: "), _digest(F.col("plain")), F.lit("\r\nsource-"),
        F.regexp_replace(F.regexp_replace("http_headers", "\r\n$", ""), "\r\n", "\r\nsource-"),
        F.lit("\r\n"))

    def record(kind: str, ident: Column, mime: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), ident.alias("record_id"),
                        F.lit(mime).alias("content_type"), block.alias("block"))

    both = plain.select(*keep, F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
                        "source_digest", F.explode(F.array(
                            record("metadata", metadata, "application/warc-fields", fields),
                            record("conversion", conversion, "text/plain", F.col("plain"))))
                        .alias("r"))
    return both.select(
        *keep, "r.warc_type", "r.record_id", "refers_to", "target_uri", "warc_date",
        "r.content_type", F.octet_length("r.block").cast("bigint").alias("content_length"),
        _digest(F.col("r.block")).alias("block_digest"), "source_digest", "r.block")


def warc_text(records: DataFrame) -> DataFrame:
    """One string per derived record, without the two line ends that follow it in a file.

    ``warc_text(r).write.option("lineSep", "\\r\\n\\r\\n").text(path)`` writes WARC files.
    """
    named = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"),
             ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"),
             ("WARC-Refers-To-Date", "warc_date"), ("WARC-Target-URI", "target_uri"),
             ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"),
             ("X-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"),
             ("Content-Length", "content_length"))
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))
             for name, c in named]
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), "block")
                          .alias("value"))


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a WARC file."""
    at = 0
    while (at := raw.find(b"WARC/1.", at)) >= 0:
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")[1:]
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        size = int(head["Content-Length"])
        yield head, raw[end + 4:end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block) of uncompressed WARC files; one task reads one file of the usual 1 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for head, block in parse_records(raw.as_py()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([list(head.items())], pa.map_(pa.string(), pa.string())),
                         pa.array([block], pa.binary())], names=["headers", "block"])

    return (spark.read.format("binaryFile").load(path).select("content")
            .mapInArrow(run, "headers map<string,string>, block binary"))


OP8_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
        md5('response:' || coalesce(page_id::VARCHAR, '') || ':' || coalesce(url, '')) AS h
    FROM pages),
r AS (SELECT *, '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-'
        || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>'
        AS refers_to, 'sha256:' || sha256(html) AS source_digest,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'),
        '<(?:{_RAW})\b[^>]*>.*?</(?:{_RAW})\s*>', ' ', 'gsi'),
        '</?(?:{_INLINE})\b[^>]*>', '', 'gi'), '<[!/?a-zA-Z][^>]*>', ' ', 'g') AS u FROM p),
t AS (SELECT *, md5('metadata:' || refers_to) AS hm, md5('conversion:' || refers_to) AS hc,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(u, '&lt;', '<'),
        '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
        '\s+', ' ', 'g')) AS plain FROM r),
i AS (SELECT *,
    '<urn:uuid:' || substr(hm, 1, 8) || '-' || substr(hm, 9, 4) || '-' || substr(hm, 13, 4)
        || '-' || substr(hm, 17, 4) || '-' || substr(hm, 21, 12) || '>' AS im,
    '<urn:uuid:' || substr(hc, 1, 8) || '-' || substr(hc, 9, 4) || '-' || substr(hc, 13, 4)
        || '-' || substr(hc, 17, 4) || '-' || substr(hc, 21, 12) || '>' AS ic FROM t),
m AS (SELECT page_id, 'metadata' AS warc_type, im AS record_id, refers_to, url AS target_uri,
    'application/warc-fields' AS content_type, source_digest,
    'conversion: ' || ic || E'\r\nsource-digest: ' || source_digest || E'\r\ntext-digest: sha256:'
        || sha256(plain) || E'\r\nsource-{HTTP_HEAD[0]}\r\nsource-{HTTP_HEAD[1]}\r\n'
        || 'source-Content-Length: ' || octet_length(encode(html)) || E'\r\n' AS block FROM i
    UNION ALL SELECT page_id, 'conversion', ic, refers_to, url, 'text/plain', source_digest,
        plain FROM i)
SELECT page_id, warc_type, record_id, refers_to, target_uri, '{DATE}' AS warc_date, content_type,
    octet_length(encode(block))::BIGINT AS content_length, 'sha256:' || sha256(block)
    AS block_digest, source_digest, block FROM m
"""


@query("op8_warc_derivatives", OP8_SQL)
def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))
