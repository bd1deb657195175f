"""WARC derivatives: responses become linked metadata and plain-text conversion records.

`responses` packs pages into response records, as a crawler would have; `derivatives` reads such records byte by byte and
builds, for each, a metadata record (the source's identifiers, digests, HTTP headers and links) and a conversion record
(its text).  Both refer to the response by its identifier, target and date and carry digests of their own.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
CAPTURED = "2024-01-01T00:00:00Z"
_BREAKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S)
_BLOCK = re.compile(rf"</?(?:{_BREAKS})\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
_LINK = re.compile(r"""<a\s[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\n ]*")
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_id(*parts: str) -> str:
    """An identifier that follows from what the record is made of, in the form of a version-8 UUID."""
    h = hashlib.sha256("\n".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _clean(value: str) -> bytes:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value).encode("utf-8", "surrogatepass")


def pack(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version, headers with length and block digest, block, two line ends."""
    lines = [VERSION, *(name.encode() + b": " + _clean(value) for name, value in headers)]
    lines += [b"WARC-Block-Digest: " + digest(block).encode(), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def readable(data: bytes) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """Headers (lower-case names) and block of each record in data, and what stopped the reading, if anything did.

    Gzip members are unpacked first: a damaged one ends the reading, of one that is cut off what there is gets read.
    """
    out: list[tuple[dict[str, str], bytes]] = []
    at, plain, broken = 0, data, None
    if data[:2] == b"\x1f\x8b":
        plain, broken = _inflated(data)
    while at < len(plain):
        end = plain.find(b"\r\n\r\n", at)
        lines = _header_text(plain[at : max(at, end)]).split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            return out, broken or "not a WARC record"
        headers = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
        if not headers.get("content-length", "").isascii() or not headers.get("content-length", "").isdigit():
            return out, "a record without a length"
        size = int(headers["content-length"])
        block = plain[end + 4 : end + 4 + size]
        if len(block) < size:
            return out, broken or "the record is cut off"
        out.append((headers, block))
        at = end + 4 + size + 4
    return out, broken


def _header_text(data: bytes) -> str:
    try:
        return data.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace")


def _inflated(data: bytes) -> tuple[bytes, str | None]:
    """Contents of gzip members, and what stopped the reading."""
    parts: list[bytes] = []
    while data:
        member = zlib.decompressobj(wbits=31)
        try:
            parts.append(member.decompress(data))
        except zlib.error:
            return b"".join(parts), "a damaged gzip member"
        if not member.eof:
            return b"".join(parts), "a gzip member that is cut off"
        data = member.unused_data.lstrip(b"\0")
    return b"".join(parts), None


def unpack(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of data that must be whole."""
    records, error = readable(data)
    if error:
        raise ValueError(error)
    return records


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response; lines may end in CR LF or LF."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, body = block.partition(b"\n\n")
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    return lines[0], [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines[1:]) if n.strip()], body


def decoded(body: bytes, headers: list[tuple[str, str]]) -> str:
    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    found = _CHARSET.search(kind)
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """Text of a page: without comments, scripts and styles, a line for each block element, entities resolved."""
    text = _TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", page)))
    text = _LINES.sub("\n", _SPACES.sub(" ", html.unescape(text)))
    return text.strip(" \n")


def links(page: str) -> list[str]:
    return [html.unescape("".join(found)) for found in _LINK.findall(_HIDDEN.sub(" ", page))]


def response(page_id: int | None, url: str | None, page: str | None) -> bytes:
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    name = record_id("response", str(page_id), url or "", digest(payload))
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", CAPTURED), ("WARC-Target-URI", url or "")]
    return pack([*headers, ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")], block)


def derive(source: dict[str, str], block: bytes) -> tuple[bytes, bytes, int]:
    """Metadata record, conversion record and number of links of a response record."""
    status, headers, body = http_parts(block)
    page = decoded(body, headers)
    name, target, date = source["warc-record-id"], source.get("warc-target-uri", ""), source.get("warc-date", CAPTURED)
    payload = source.get("warc-payload-digest") or digest(body)
    refers = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", name), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)]
    found = links(page)
    fields = [("source-payload-digest", payload), ("source-block-digest", source.get("warc-block-digest") or digest(block)), ("http-status", status)]
    fields += [("http-header", f"{n}: {v}") for n, v in headers] + [("outlink", x) for x in found]
    about = b"".join(n.encode() + b": " + _clean(v) + b"\r\n" for n, v in fields)
    text = plain_text(page).encode("utf-8", "surrogatepass")
    metadata = pack([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", name)), *refers, ("Content-Type", "application/warc-fields")], about)
    conversion = [("WARC-Type", "conversion"), ("WARC-Record-ID", record_id("conversion", name)), *refers, ("WARC-Concurrent-To", record_id("metadata", name)), ("WARC-Source-Payload-Digest", payload)]
    return metadata, pack([*conversion, ("Content-Type", "text/plain; charset=utf-8")], text), len(found)


def responses(pages: DataFrame) -> DataFrame:
    """page_id and the response record of every row of pages (page_id, url, html); NULL html is an empty page."""

    def run(batches):
        for batch in batches:
            made = [response(*row) for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")))]
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(made, pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, record binary")


def derived(data: bytes | None) -> list[tuple[int | None, bytes | None, bytes | None, int | None, str | None]]:
    """Place, metadata, conversion, number of links and error for each response record in data and for what cannot be read."""
    if not data:
        return [(None, None, None, None, None)]
    records, error = readable(data)
    out: list[tuple] = []
    for place, (headers, block) in enumerate(records):
        if headers.get("warc-type", "").lower() != "response":
            continue
        if headers.get("warc-record-id"):
            out.append((place, *derive(headers, block), None))
        else:
            out.append((place, None, None, None, "a response without an identifier"))
    if error:
        out.append((len(records), None, None, None, error))
    return out


def derivatives(records: DataFrame, compress: bool = False) -> DataFrame:
    """page_id, place, metadata, conversion (records, as gzip members if asked for), n_links, error for the rows of (page_id, record).

    A record column holds any number of WARC records, in gzip members or not.  Each response among them gives a row, place
    being its number from 0; records of other types give none.  Where a record cannot be read, the ones before it count and
    a row with its place and an error, but without records, stands for the rest.  A NULL or empty record gives a row of NULLs.
    Repeated rows give the same records.
    """

    def run(batches):
        wrap = (lambda data: gzip.compress(data, mtime=0)) if compress else bytes
        names = ["page_id", "place", "metadata", "conversion", "n_links", "error"]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            rows = [(page, *found) for page, data in zip(batch["page_id"].to_pylist(), batch["record"].to_pylist()) for found in derived(data)]
            columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
            for i in (2, 3):
                columns[i] = [None if x is None else wrap(x) for x in columns[i]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return records.select(F.col("page_id").cast("long").alias("page_id"), "record").mapInArrow(run, "page_id bigint, place int, metadata binary, conversion binary, n_links bigint, error string")


def digests(derived: DataFrame) -> DataFrame:
    """page_id, identifiers, digests and sizes, as read back from the derivative records."""
    schema = "page_id bigint, refers_to string, target_uri string, metadata_id string, conversion_id string, payload_digest string, metadata_digest string, text_digest string, n_text bigint, n_links bigint"

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for page, metadata, conversion, n in zip(*(batch[c].to_pylist() for c in ("page_id", "metadata", "conversion", "n_links"))):
                about, text = unpack(metadata)[0][0], unpack(conversion)[0]
                values = (page, text[0]["warc-refers-to"], text[0]["warc-target-uri"], about["warc-record-id"], text[0]["warc-record-id"], text[0]["warc-source-payload-digest"], about["warc-block-digest"], text[0]["warc-block-digest"], len(text[1]), n)
                for column, value in zip(out, values):
                    column.append(value)
            types = [pa.int64(), *[pa.string()] * 7, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [x.split(" ")[0] for x in schema.split(", ")])

    return derived.where("metadata is not null").mapInArrow(run, schema)
