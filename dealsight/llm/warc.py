"""Derived archive records: responses become linked metadata and plain-text conversion records (WARC 1.1).

Both derived records refer to the response by its identifier and target, name each other as concurrent, and carry the
source's HTTP header lines and payload digest, so either can be traced without the original file.  Identifiers are named
from the source identifier and the kind, so a rerun writes the same records.

Defined cases: a null or empty payload gives a conversion record with an empty block; a null target is left out of the
headers; unclosed comments, scripts and tags reach to the end of the text; repeated rows give equal records; an empty
table gives none.
"""
from __future__ import annotations

import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealsight.llm.common import map_batches

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
HIDDEN = r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b[^>]*(?:>|\Z).*?(?:</\1\s*(?:>|\Z)|\Z)"
MARKUP = re.compile(HIDDEN + r"|<!(?!--)[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*(?:>|\Z)", re.S | re.I)
BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre "
                   "section table tbody td tfoot th thead tr ul".split())
TITLE_START, TITLE_END, LINK_START = (re.compile(x, re.I) for x in (r"<title\b", r"</title", r"<a\b"))
HREF = re.compile(r"\bhref\s*=\s*", re.I)
VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
FIELDS = ("record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "content_type", "block_digest", "source_digest", "headers", "block")


def plain_text(page: str) -> str:
    """The visible text of a page: markup out, a line for each block, references resolved, white space joined."""
    flat = MARKUP.sub(lambda m: "\n" if (m.group(3) or "").lower() in BLOCKS else "", page)
    lines = (" ".join(x.split()) for x in html.unescape(flat).split("\n"))
    return "\n".join(x for x in lines if x)


def title_of(page: str) -> str:
    start = TITLE_START.search(page)
    at = page.find(">", start.end()) if start else -1
    if at < 0:
        return ""
    end = TITLE_END.search(page, at + 1)
    return page[at + 1:end.start() if end else len(page)]


def links_of(page: str) -> list[str]:
    """The first href of every anchor tag; each part of the page is read once, however many tags stay open."""
    out, at = [], 0
    while tag := LINK_START.search(page, at):
        end = page.find(">", tag.end())
        end = len(page) if end < 0 else end
        href = HREF.search(page, tag.end(), end)
        at = end
        if href and (value := VALUE.match(page, href.end())):
            out.append(next(v for v in value.groups() if v is not None))
            at = value.end()
    return out


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{source} {kind}')}>"


def digest(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


def field(text: str) -> str:
    """A header value holds no line ends."""
    return " ".join(text.split())


def record(kind: str, source: dict, content_type: str, block: str) -> tuple:
    """One derived record in the order of ``FIELDS``."""
    raw = block.encode()
    other = "conversion" if kind == "metadata" else "metadata"
    own, twin = record_id(source["record_id"], kind), record_id(source["record_id"], other)
    lines = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", source["warc_date"]),
             ("WARC-Refers-To", source["record_id"]), ("WARC-Refers-To-Target-URI", source["target_uri"]),
             ("WARC-Refers-To-Date", source["warc_date"]), ("WARC-Target-URI", source["target_uri"]),
             ("WARC-Concurrent-To", twin), ("WARC-Source-Payload-Digest", source["payload_digest"]),
             ("WARC-Block-Digest", digest(raw)), ("Content-Type", content_type), ("Content-Length", str(len(raw)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {field(v)}\r\n" for k, v in lines if v is not None) + "\r\n"
    return (kind, own, source["record_id"], twin, source["target_uri"], content_type, digest(raw), source["payload_digest"], head, block)


def metadata_block(source: dict, text: str) -> str:
    """Fields of the page and, each with its name in front, the header lines of the source."""
    page = source["payload"] or ""
    out = [("title", html.unescape(title_of(page))), ("text-characters", str(len(text)))]
    out += [("outlink", html.unescape(link)) for link in links_of(page)]
    out += [("source-header", line) for line in (source["http_headers"] or "").split("\r\n") if line]
    return "".join(f"{k}: {field(v)}\r\n" for k, v in out)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records, named from id, target and payload.  The table has no capture time, so one date stands for all."""
    body = F.coalesce("html", F.lit(""))
    name = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-")), F.sha2(body, 256))
    h = F.md5(name)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))
    return pages.select(F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"),
                        F.lit(date).alias("warc_date"), http.alias("http_headers"), F.col("html").alias("payload"),
                        F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("payload_digest"))


def derive(source: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r in b.to_pylist():
            text = plain_text(r["payload"] or "")
            rows.append(record("metadata", r, "application/warc-fields", metadata_block(r, text)))
            rows.append(record("conversion", r, "text/plain; charset=utf-8", text))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], FIELDS)

    return map_batches(source, batch, ", ".join(f"{c} string" for c in FIELDS))


def write(records: DataFrame, folder: str) -> None:
    """Records as files in WARC form, one a partition; the format ends each record with two line ends."""
    records.select(F.concat("headers", "block").alias("value")).write.option("lineSep", "\r\n\r\n").mode("overwrite").text(folder)
