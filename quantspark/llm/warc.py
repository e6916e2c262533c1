"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is a row: ``record_id, warc_type, target_uri, warc_date, fields`` (other named fields),
``content_type, block`` (bytes). Derivatives keep what they come from: WARC-Refers-To with the
response's identifier, address and date, its HTTP status and headers, and its digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.llm.common import pieces

RECORD = "record_id string, warc_type string, target_uri string, warc_date string, fields map<string,string>, content_type string, block binary"
COLUMNS = ["record_id", "warc_type", "target_uri", "warc_date", "fields", "content_type", "block"]
ARROW = pa.schema([
    ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
    ("fields", pa.map_(pa.string(), pa.string())), ("content_type", pa.string()), ("block", pa.binary()),
])
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "quantspark/warc")
#: date of captures whose table has none
NO_DATE = "1970-01-01T00:00:00Z"

#: what is not shown, or begins so
_OPENS = re.compile(r"<(!--|(?:script|style|noscript|template|svg|head)\b)", re.I)
_CLOSES = {"!--": re.compile("-->")} | {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg")}
_TAG_REST = re.compile(r"[^<>]*>?")
#: what a head holds besides; anything else ends it, as in browsers
_IN_HEAD = re.compile(
    r"\s+|<title\b[^<>]*>(?:[^<]|<(?!/?(?:title|head|body)\b))*(?:</title\s*>)?"
    r"|</?(?:meta|link|base|basefont|bgsound)\b[^<>]*>|</(?:title|script|style|noscript|template)\s*>|<(?:html\b|[?]|!(?!--))[^<>]*>",
    re.I,
)
_HEAD_END = re.compile(r"</head\s*>", re.I)
_BREAKS = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul)\b[^<>]*>",
    re.I,
)
_TAGS = re.compile(r"<[A-Za-z/!?][^<>]*>")
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_LINKS = re.compile(r"""<a\s[^<>]*?\bhref\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)'|([^\s"'<>]+))""", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def identifier(*parts: str) -> str:
    """A record's identifier, the same in every run: named after what the record is made of."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, chr(0).join(parts))}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hidden_end(source: str, found: re.Match, unclosed: set[str]) -> int:
    """Where what ``found`` opens ends. Comments, scripts and styles without an end take the rest of the page.

    Others without an end, and an svg closed in its own tag, hide that tag only. ``unclosed``
    remembers names that no end follows, so that a page is not searched for them again.
    """
    name = found[1].lower()
    tag = found.end() if name == "!--" else _TAG_REST.match(source, found.end()).end()
    if name == "svg" and source.endswith("/>", found.end(), tag):
        return tag
    close = None if name in unclosed else _CLOSES[name].search(source, found.end())
    if close:
        return close.end()
    unclosed.add(name)
    return len(source) if name in ("!--", "script", "style") else tag


def shown(source: str) -> str:
    """A page without what is not shown: a blank for each comment, head, script and the like."""
    out, at, unclosed = [], 0, set()
    while found := _OPENS.search(source, at):
        out += [source[at : found.start()], " "]
        if found[1].lower() != "head":
            at = hidden_end(source, found, unclosed)
            continue
        at = _TAG_REST.match(source, found.end()).end()
        while True:  # </head> can be left out
            if part := _IN_HEAD.match(source, at):
                at = part.end()
            elif (part := _OPENS.match(source, at)) and part[1].lower() not in ("head", "svg"):
                at = hidden_end(source, part, unclosed)
            else:
                break
        if end := _HEAD_END.match(source, at):
            at = end.end()
    return "".join([*out, source[at:]])


def page_text(source: str) -> str:
    """The visible text of a page: one line per block element, blanks collapsed, empty lines left out."""
    plain = html.unescape(_TAGS.sub("", _BREAKS.sub("\n", shown(source))))
    return "\n".join(line for line in (" ".join(x.split()) for x in plain.split("\n")) if line)


def page_title(source: str) -> str:
    found = _TITLE.search(source)
    return " ".join(html.unescape(found[1]).split()) if found else ""


def page_links(source: str) -> list[str]:
    return [html.unescape(next(g for g in m.groups() if g is not None)).strip() for m in _LINKS.finditer(source)]


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; what follows a broken chunk is kept as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            out.append(body[at:])
            break
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload as sent; a block without an HTTP head is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()]
    return lines[0], headers, body


def decoded(headers: list[tuple[str, str]], body: bytes) -> str:
    """The payload's text: transfer and content codings undone where they can be, then the charset."""
    named = {k.lower(): v for k, v in headers}
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = unchunked(body)
    coding = named.get("content-encoding", "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif coding == "deflate":
            body = zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass  # a damaged body is read as it stands
    charset = _CHARSET.search(named.get("content-type", ""))
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive(record_id: str, uri: str | None, date: str | None, fields: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, headers, body = parse_http(block)
    source = decoded(headers, body)
    text = page_text(source).encode("utf-8")
    of_source = {
        "WARC-Refers-To": record_id,
        **({"WARC-Refers-To-Target-URI": uri} if uri else {}),
        "WARC-Refers-To-Date": date or NO_DATE,
        "WARC-Source-Payload-Digest": fields.get("WARC-Payload-Digest") or digest(body),
        "WARC-Source-Block-Digest": fields.get("WARC-Block-Digest") or digest(block),
    }
    lines = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in headers), ("title", page_title(source))]
    lines += [("outlink", x) for x in page_links(source)]
    about = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines).encode("utf-8")
    meta_id, text_id = identifier(record_id, "metadata"), identifier(record_id, "conversion")
    made = []
    for own, other, kind, content, data in (
        (meta_id, text_id, "metadata", "application/warc-fields", about),
        (text_id, meta_id, "conversion", "text/plain; charset=utf-8", text),
    ):
        named = {**of_source, "WARC-Concurrent-To": other, "WARC-Block-Digest": digest(data)}
        made.append({"record_id": own, "warc_type": kind, "target_uri": uri, "warc_date": date or NO_DATE, "fields": named, "content_type": content, "block": data})
    return made


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = NO_DATE) -> DataFrame:
    """Pages as response records: an HTTP head, then the page, with payload and block digests.

    A null page is an empty payload; a null address leaves WARC-Target-URI out. Equal rows are
    the same capture and share an identifier. Other columns are not read; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, html_col):
            rows = []
            for r in batch.to_pylist():
                body = (r[html_col] or "").encode("utf-8")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                block = head.encode() + body
                fields = {"WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(block)}
                own = identifier(str(r[id_col]), r[url_col] or "", fields["WARC-Payload-Digest"])
                rows.append({"record_id": own, "warc_type": "response", "target_uri": r[url_col], "warc_date": date, "fields": fields, "content_type": "application/http; msgtype=response", "block": block})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """Two records, metadata and conversion, for every response among ``records``; no shuffle.

    Other record types pass by. A null block is an empty one; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "block"):
            rows = []
            for r in batch.to_pylist():
                rows += derive(r["record_id"] or "", r["target_uri"], r["warc_date"], dict(r["fields"] or []), r["block"] or b"")
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return records.where(F.col("warc_type") == "response").select(*COLUMNS).mapInArrow(run, RECORD)


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """WARC/1.1 files under ``path``, one per task: Spark's text writer ends each record with two line ends."""
    named = F.array_join(F.transform(F.map_entries(F.coalesce("fields", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n"))), "")
    block = F.coalesce("block", F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "warc_type", F.lit("\r\nWARC-Record-ID: "), "record_id", F.lit("\r\nWARC-Date: "), F.coalesce("warc_date", F.lit(NO_DATE)),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), "target_uri"), F.lit("")), F.lit("\r\n"), named,
        F.lit("Content-Type: "), "content_type", F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    whole = F.concat(head.cast("binary"), block).cast("string")  # bytes stay as they are
    records.select(whole.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of one WARC file, found by their lengths; gzip members are undone first.

    Where a length is missing or no number, the block ends before the next record or with the file.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        named = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        length = named.pop("Content-Length", "").strip()
        if length.isascii() and length.isdigit() and len(length) < 19:
            size = int(length)
        else:
            following = data.find(b"\r\n\r\nWARC/", end + 4)
            size = (following if following >= 0 else len(data)) - end - 4
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        yield {
            "record_id": named.pop("WARC-Record-ID", None), "warc_type": named.pop("WARC-Type", None), "target_uri": named.pop("WARC-Target-URI", None),
            "warc_date": named.pop("WARC-Date", None), "content_type": named.pop("Content-Type", None), "fields": named, "block": block,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under ``path``; one file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held: list[dict] = []
                for record in parse_warc(data):
                    held.append(record)
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def derivatives_of_pages(pages: DataFrame) -> DataFrame:
    """One row per derivative record of every page, with what it preserves and its block's checksum."""
    f = lambda name: F.col("fields")[name]
    return derivatives(responses(pages)).select(
        "record_id", "warc_type", "target_uri", f("WARC-Refers-To").alias("refers_to"), f("WARC-Refers-To-Target-URI").alias("refers_to_uri"),
        f("WARC-Concurrent-To").alias("concurrent_to"), f("WARC-Source-Payload-Digest").alias("source_payload_digest"),
        f("WARC-Source-Block-Digest").alias("source_block_digest"), f("WARC-Block-Digest").alias("block_digest"),
        "content_type", F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"),
    )
