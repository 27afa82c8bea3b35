"""WARC derivatives: metadata and plain-text conversion records for response records.

For each response there is one ``metadata`` record (application/warc-fields: HTTP
status, the source's HTTP headers, its record id, date and digests, the page's
title, charset and counts) and, where the payload is text, one ``conversion``
record (text/plain): the visible text of HTML, other text types as they are. Both name their source by WARC-Refers-To, with its target
URI and date, and each other by WARC-Concurrent-To; both carry a SHA-1 block
digest, and the digests of the source are handed on as they are, or computed
where it has none. Record ids are name-based (a hash of source id and type), so
a lost task that runs again writes the same records.

All of it is a map over rows: no shuffle, one record in memory at a time. Files
are read and written with Spark's text source and sink, whose line separator is what
ends a record, so both work on any file system that Spark knows: plain files are
split, compressed ones (gzip members, one a record or not) are read as a stream, and
no task holds a file. A record's Content-Length decides where it ends; where its
block holds a separator (a blank line and WARC/), the pieces are put together again,
but for a plain file that is split at just that place.

Defined results: a null payload is an empty one; a null or empty URI gives records
without a target URI; no HTTP header block gives no status; broken markup never
fails: an unclosed comment, tag, script or style ends at the end of the page, an
unclosed title at the next tag, and other unclosed elements hide nothing; a head
needs no end, as text in it counts as the body's;
bytes that are not in the stated charset become U+FFFD, and a charset that is none
(unknown, or no text encoding) is read as UTF-8; rows are mapped one by
one, so repeated rows give repeated records and an empty table gives none; other
columns of the input are passed on by ``keep``.
"""
from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Elements whose content is no text, and elements that end a line.
SILENT = frozenset("script style template noscript iframe object svg".split())
TO_THE_END = frozenset(("script", "style"))
LINES = frozenset("address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?]", re.A)
END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.A | re.I) for name in (*SILENT, "title")}
BLANKS, LINE_BLANKS = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[ \n]*")
#: Codecs of Python that no page is written in.
NO_CHARSETS = frozenset(("idna", "punycode", "undefined", "raw-unicode-escape", "unicode-escape"))
RESPONSE = "record_id string, target_uri string, date string, headers map<string,string>, block binary"


def sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def end_of_tag(text: str, at: int) -> int:
    """The place after a tag's closing bracket, brackets in quotes apart."""
    end = text.find(">", at)
    if end < 0:
        return len(text)
    inside = text[at:end]
    if '"' not in inside and "'" not in inside:
        return end + 1
    quote = ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return i + 1
    return end + 1  # a quote that is never closed is no quote


def plain_text(page: str) -> tuple[str, str]:
    """Visible text of a page, and its title."""
    out, at, title, endless = [], 0, "", set()
    while m := TAG.search(page, at):
        out.append(page[at : m.start()])
        if m.group(0) == "<!--":
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            continue
        at = end_of_tag(page, m.end())
        if not m.group(2):
            continue
        name = m.group(2).lower()
        if name in END and not m.group(1) and page[at - 2 : at] != "/>":
            end = None if name in endless else END[name].search(page, at)
            if not end:  # nor has any that follows
                endless.add(name)
            if name == "title":
                stop = end or TAG.search(page, at)
                begin, at = at, stop.start() if stop else len(page)
                title = title or " ".join(html.unescape(page[begin:at]).split())
            elif end:
                at = end_of_tag(page, end.end())
            elif name in TO_THE_END:
                at = len(page)
        elif name in LINES:
            out.append("\n")
        else:
            continue
    out.append(page[at:])
    text = BLANKS.sub(" ", html.unescape("".join(out)).replace("\r", "\n"))
    return LINE_BLANKS.sub("\n", text).strip(), title


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and body of a response block; without a status line everything is body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    fields = [(k.strip(), v.strip()) for k, colon, v in (line.partition(":") for line in lines) if colon]
    return first, fields, body


def decoded(body: bytes, fields: dict[str, str]) -> bytes:
    """The body without its content coding; as it is if that fails."""
    try:
        if fields.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if fields.get("content-encoding", "").lower() == "deflate":
            return zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return body


def charset_of(kind: str) -> str:
    """The charset of a content type if it is a text encoding that decodes anything; else UTF-8."""
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    try:
        if m and isinstance(b"\x41\xc3\x80.\x00".decode(m[1], "replace"), str) and codecs.lookup(m[1]).name not in NO_CHARSETS:
            return m[1]
    except (LookupError, UnicodeError, ValueError, AssertionError):
        pass
    return "utf-8"


def derive_one(source_id: str, uri: str | None, date: str, headers: dict[str, str], block: bytes) -> list[dict]:
    """Metadata and, for text, conversion record of a response."""
    status, fields, body = split_http(block)
    named = {k.lower(): v for k, v in fields}
    kind = named.get("content-type", "text/html")
    block_digest = headers.get("WARC-Block-Digest") or sha1(block)
    payload_digest = headers.get("WARC-Payload-Digest") or sha1(body)
    ids = {t: record_id(source_id, t) for t in ("metadata", "conversion")}
    media = kind.split(";")[0].strip().lower()
    is_html = media in ("text/html", "application/xhtml+xml", "")
    is_text = is_html or media.startswith("text/")
    text = title = ""
    charset = charset_of(kind)
    if is_text:
        page = decoded(body, named).decode(charset, "replace")
        text, title = plain_text(page) if is_html else (page, "")
    clean = lambda v: re.sub(r"[\r\n]+", " ", v)
    lines = [("source-record-id", source_id), ("source-date", date), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("source-block-length", str(len(block)))]
    lines += [("http-status", status)] * bool(status) + [(f"http-header-{k.lower()}", v) for k, v in fields]
    lines += [(f"warc-header-{k.lower()}", v) for k, v in sorted(headers.items()) if k not in ("WARC-Block-Digest", "WARC-Payload-Digest")]
    lines += [("title", title)] * bool(title) + [("charset", charset)] * is_text + [("text-length", str(len(text)))] * is_text
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {clean(v)}\r\n" for k, v in lines))]
    if is_text:
        made.append(("conversion", "text/plain; charset=utf-8", text))
    out = []
    for name, content, body_text in made:
        raw = body_text.encode("utf-8", "replace")
        out.append({
            "record_type": name, "record_id": ids[name], "refers_to": source_id, "concurrent_to": ids["conversion" if name == "metadata" else "metadata"] if is_text else None,
            "target_uri": uri or None, "date": date, "content_type": content, "source_block_digest": block_digest, "source_payload_digest": payload_digest,
            "block_digest": sha1(raw), "content_length": len(raw), "block": raw.decode(),
        })
    return out


RECORD_COLUMNS = (
    "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "source_block_digest", "source_payload_digest", "block_digest", "content_length", "block",
)
RECORD = T.StructType([T.StructField(c, T.LongType() if c == "content_length" else T.StringType()) for c in RECORD_COLUMNS])


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records: ``page``, a struct of all of pages' columns, and the columns of RESPONSE.

    Record ids are made from id, URI and content. As the caller's columns are in one struct, none of their names can clash."""
    id_col, url_col, html_col = f"`{id_col}`", f"`{url_col}`", f"`{html_col}`"
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    name = F.sha1(F.concat_ws("\u0000", F.col(id_col).cast("string"), F.col(url_col), F.sha1(body)).cast("binary"))
    urn = F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(name, a, n), F.lit("-" if a < 21 else ">"))])
    page = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page")
    return pages.select(page, urn.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), F.create_map().cast("map<string,string>").alias("headers"), F.concat(head, body).alias("block"))


def derive(source: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Derivative records of responses (columns of RESPONSE), each with the columns named in ``keep``, such as ``page``. A column
    that has a record column's name can't be kept under it: rename it, or put it into a struct."""
    if clash := set(keep) & {f.name for f in RECORD}:
        raise ValueError(f"names of record columns can't be kept: {sorted(clash)}")
    kept = [source.schema[c] for c in keep]
    out = T.StructType([*kept, *RECORD.fields])
    rows = source.select(*keep, *[F.col(f.name).alias(f"__{f.name}") for f in T.StructType.fromDDL(RESPONSE)])
    n, schema = len(keep), to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            columns = [c for c in batch.columns]
            for at in range(0, batch.num_rows, 256):
                part = [c.slice(at, 256) for c in columns]
                made, origin = [], []
                for row, (rid, uri, date, headers, block) in enumerate(zip(*(c.to_pylist() for c in part[n:]))):
                    records = derive_one(rid or record_id(uri or ""), uri, date or "", dict(headers or {}), block or b"")
                    made += records
                    origin += [row] * len(records)
                take = pa.array(origin, pa.int64())
                arrays = [c.take(take) for c in part[:n]] + [pa.array([m[f.name] for m in made], schema.field(f.name).type) for f in RECORD]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return rows.mapInArrow(run, out)


def serialized(records: DataFrame) -> DataFrame:
    """Records as WARC/1.0 text without the closing separator, in column ``value``."""
    field = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c), F.lit("\r\n"))).otherwise(F.lit(""))
    head = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type")]
    length = F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"))
    return records.select(F.concat(F.lit("WARC/1.0\r\n"), *[field(*x) for x in head], length, F.col("block")).alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one a partition; the text sink's line separator is what ends a record."""
    serialized(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


#: What stands between the records of a file: the end of one and how the next begins.
SEPARATOR = b"\r\n\r\nWARC/"


class Records:
    """Puts records together from what stands between separators: state is one record."""

    def __init__(self):
        self.held, self.fields, self.start, self.end = bytearray(), None, 0, 0

    def feed(self, piece: bytes) -> tuple[dict[str, str], bytes] | None:
        """A record, if the piece ends one."""
        if self.fields is None:
            piece = piece.lstrip(b"\r\n").removeprefix(SEPARATOR[4:])
            self.start = piece.find(b"\r\n\r\n") + 4
            if not piece[:1].isdigit() or self.start < 4:
                return None
            lines = piece[: self.start - 4].decode("utf-8", "replace").split("\r\n")[1:]
            self.fields = {k.strip(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}
            self.end = self.start + next((int(v) for k, v in self.fields.items() if k.lower() == "content-length" and v.isdigit()), 0)
            self.held = bytearray(piece)
        else:  # its block holds a separator
            self.held += SEPARATOR + piece
        return self.finish() if len(self.held) >= self.end else None

    def finish(self) -> tuple[dict[str, str], bytes] | None:
        """The record that is open, if any, as far as it goes."""
        fields, self.fields = self.fields, None
        return (fields, bytes(self.held[self.start : self.end])) if fields is not None else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: record_type and the columns of RESPONSE."""
    schema = "record_type string, " + RESPONSE

    def made(records):
        rows = [({k.lower(): v for k, v in fields.items()}, fields, block) for fields, block in records]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([low.get(k) for low, _, _ in rows], pa.string()) for k in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date")), pa.array([list(fields.items()) for _, fields, _ in rows], pa.map_(pa.string(), pa.string())), pa.array([block for _, _, block in rows], pa.binary())],
            ["record_type", "record_id", "target_uri", "date", "headers", "block"],
        )

    def run(batches):
        records, file = Records(), None
        for batch in batches:
            out = []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != file:
                    out.append(records.finish())
                    file = name
                out.append(records.feed(piece))
            yield made([r for r in out if r])
        yield made([r for r in [records.finish()] if r])

    pieces = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    return pieces.select(F.col("_metadata.file_path"), F.col("value").cast("binary")).mapInArrow(run, schema)
