"""WARC derivative builder (operator 6).

Each web response gives three linked records: the response itself, a metadata
record (``WARC-Concurrent-To`` and ``WARC-Refers-To`` the response) with what
was read off the page, and a conversion record (``WARC-Refers-To`` the
response) whose block is the page's plain text.  Target URI and date go on to
the derivatives, and each has its block's digest; the metadata keeps the
source's headers and payload digest.

Identifiers are made from the record's own content, so a repeated run or a
retried task writes the same ones.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is no text, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template", "head", "svg", "iframe", "textarea")
#: Hidden elements that last to the page's end without an end tag, and what a head may hold.
RAW = ("script", "style", "textarea")
IN_HEAD = ("base", "basefont", "bgsound", "head", "html", "link", "meta", "noscript", "script", "style", "template", "title")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1",
          "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td",
          "th", "tr", "ul")

# What a tag holds up to its end; possessive, so that no page is read again from an earlier place.
_INSIDE = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_NAME = re.compile(rf"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*+>?|/?([a-zA-Z][^\s/>]*+){_INSIDE}>?)", re.S)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*HIDDEN, "title")}
_OPEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(a|html|title)(?=[\s/>])({_INSIDE})>?", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?", re.S)
_LANGUAGE = re.compile(r"[A-Za-z0-9-]+")
_TITLE_END = re.compile(r"</title", re.I)
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def _past(page: str, at: int, name: str, endless: set[str]) -> int:
    """Where the element ends whose start tag ends at ``at``; an element
    without an end tag is its start tag alone, unless it is raw text.
    ``endless``: elements that have no end tag from here on."""
    end = None if name in endless else _ENDS[name].search(page, at)
    if end:
        return end.end()
    endless.add(name)
    return len(page) if name in RAW else at


def _past_head(page: str, at: int, endless: set[str]) -> int:
    """Where a head ends: after its end tag, at <body>, or, without either,
    at the first text or element that cannot be in a head."""
    if "head" in endless:
        return at
    first = None
    while m := _NAME.search(page, at):
        name, end_tag = (m[2] or "").lower(), m[0].startswith("</")
        if first is None and page[at:m.start()].strip():
            first = at
        if name == "head" and end_tag:
            return m.end()
        if name == "body" and not end_tag:
            return m.start()
        if first is None and name and (name in ("body", "html") if end_tag else name not in IN_HEAD):
            first = m.start()
        at = m.end()
        if name in _ENDS and name != "head" and not end_tag and not m[0].endswith("/>"):
            at = _past(page, at, name, endless)
    endless.add("head")
    if first is None:
        first = at
    return first


def plain_text(page: str) -> str:
    """A page's visible text: a line for each block, white space folded, entities resolved."""
    out, at, endless = [], 0, set()
    while True:
        m = _NAME.search(page, at)
        if not m:
            out.append(html.unescape(page[at:]))
            break
        out.append(html.unescape(page[at:m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if m[1] is not None:
            out.append(m[1])
        elif name in BLOCKS:
            out.append("\n")
        elif name in HIDDEN and m[0][1] != "/" and not m[0].endswith("/>"):
            at = _past_head(page, at, endless) if name == "head" else _past(page, at, name, endless)
            out.append("\n" if name == "head" else " ")
    return _LINES.sub("\n", _SPACE.sub(" ", "".join(out))).strip()


def facts(page: str) -> tuple[str | None, str | None, int]:
    """A page's title, the language its html element names, and its number of
    links (elements a with an href), in one pass over its tags."""
    title = lang = None
    links, titles, at = 0, True, 0
    while m := _OPEN.search(page, at):
        at, name = m.end(), (m[1] or "").lower()
        if name == "a":
            links += any(x[1].lower() == "href" for x in _ATTRIBUTE.finditer(m[2]))
        elif name == "html" and lang is None:
            value = next((x[2] for x in _ATTRIBUTE.finditer(m[2]) if x[1].lower() == "lang" and x[2]), "")
            found = _LANGUAGE.match(value.strip("\"' "))
            lang = found[0].lower() if found else None
        elif name == "title" and titles:
            # Without an end tag from here on no later title has one either.
            titles, end = False, _TITLE_END.search(page, at)
            if end:
                title, at = " ".join(html.unescape(page[at:end.start()]).split()), end.start()
    return title, lang, links


def _read(pages: DataFrame) -> DataFrame:
    """pages with text, title, lang and n_links of column payload (null: empty)."""
    schema = T.StructType(list(pages.schema.fields)).add("text", "string").add("title", "string").add("page_lang", "string").add("n_links", "long")

    def run(batches):
        at = pages_columns.index("payload")
        for batch in batches:
            got = []
            for page in batch.column(at).to_pylist():
                got.append((plain_text(page or ""), *facts(page or "")))
            text, title, lang, links = zip(*got) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(text, pa.string()), pa.array(title, pa.string()), pa.array(lang, pa.string()),
                 pa.array(links, pa.int64())], names=schema.names)

    pages_columns = pages.columns
    return pages.mapInArrow(run, schema)


def record_id(*parts: Column) -> Column:
    """A urn:uuid of the SHA-256 of the parts, nulls told from empty ones."""
    named = [F.coalesce(F.concat(F.lit("+"), p.cast("string")), F.lit("-")) for p in parts]
    h = F.sha2(F.concat_ws("\u001f", *named), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3),
                    F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _clean(value: Column) -> Column:
    """A header value: no line breaks or other control characters."""
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]+", " ")


def derive(responses: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Three rows per response: page_id, type, record_id, refers_to,
    target_uri, content_type, content_length (bytes), block_digest,
    payload_digest (the response's and, on its derivatives, the source's), block,
    headers (the record's header lines).

    ``responses`` has page_id, url, html; also, where it has them, date and
    http_headers (strings).  A source without headers or date gets a plain status line and ``date`` in
    the response, which must have them, and its metadata says "not given".
    Null pages have an empty payload, null urls no target; identical rows give identical records, each its own.
    """
    have = set(responses.columns)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    default = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                       F.octet_length(payload).cast("string"), F.lit("\r\n"))
    given = F.rtrim(F.regexp_replace(F.col("http_headers"), r"\r?\n", "\r\n")) if "http_headers" in have else F.lit(None).cast("string")
    http = F.when(given.isNull(), default).otherwise(F.concat(F.regexp_replace(given, r"(\r\n)+$", ""), F.lit("\r\n")))
    rows = _read(responses.select(
        "page_id", _clean(F.col("url").cast("string")).alias("target_uri"), payload.alias("payload"), http.alias("http"),
        (F.coalesce(F.col("date").cast("string"), F.lit(date)) if "date" in have else F.lit(date)).alias("date"),
        given.isNull().alias("no_http"), (F.col("date").isNull() if "date" in have else F.lit(True)).alias("no_date")))
    source = record_id(F.lit("response"), F.col("page_id"), F.col("target_uri"), F.col("date"), F.col("payload"))
    rows = rows.withColumns({"source_id": source, "payload_digest": digest(F.col("payload"))})

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    known = F.concat(
        line("title", _clean(F.col("title"))), line("language", F.col("page_lang")), line("outlinks", F.col("n_links").cast("string")),
        line("source-payload-digest", F.col("payload_digest")), line("source-content-length", F.octet_length("payload").cast("string")),
        F.when(F.col("no_date"), F.lit("source-date: not given\r\n")).otherwise(F.lit("")),
        F.when(F.col("no_http"), F.lit("source-headers: not given\r\n")).otherwise(F.lit("")),
        F.regexp_replace(F.col("http"), r"(?m)^(?=[^\r\n])", "source-http: "))
    record = lambda kind, block, mime, refers, own: F.struct(
        F.lit(kind).alias("type"), own.alias("record_id"), refers.alias("refers_to"), F.lit(mime).alias("content_type"), block.alias("block"))
    me = F.col("source_id")
    nothing = F.lit(None).cast("string")
    three = F.array(
        record("response", F.concat("http", F.lit("\r\n"), "payload"), "application/http; msgtype=response", nothing, me),
        record("metadata", known, "application/warc-fields", me, record_id(F.lit("metadata"), me)),
        record("conversion", F.col("text"), "text/plain; charset=utf-8", me, record_id(F.lit("conversion"), me)))
    out = rows.select("page_id", "target_uri", "date", "payload_digest", F.explode(three).alias("x")).select(
        "page_id", "x.type", "x.record_id", "x.refers_to", "target_uri", "x.content_type",
        F.octet_length("x.block").cast("long").alias("content_length"), digest(F.col("x.block")).alias("block_digest"),
        "payload_digest", "date", "x.block")
    return out.withColumn("headers", F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.col("refers_to")),
        F.when(F.col("type") == "metadata", line("WARC-Concurrent-To", F.col("refers_to"))).otherwise(F.lit("")),
        F.when(F.col("type") == "response", line("WARC-Payload-Digest", F.col("payload_digest"))).otherwise(F.lit("")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")))).drop("date")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file per partition under ``path``, in any store that Spark
    writes to; the blank lines that end a record are the text writer's line end."""
    (records.select(F.concat("headers", F.lit("\r\n"), "block").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path))
