"""WARC derivatives: metadata and plain-text conversion records of responses.

Records are rows: ``head``, the lines of the header fields without Content-Length, and
``block``, the content as bytes.
Files are written by Spark's text writer, which ends every row with a separator: with
the two line ends that close a record as separator, a file of rows is a WARC file, and
gzip is the writer's option.  Files are read by the text source, cut where a record
begins; a piece that is shorter than its Content-Length, because its block holds such a
place itself, is joined with the next.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineflow.llm.shipping import ship_package

ROWS_AT_A_TIME = 128

LINE = "\r\n"
RECORD_END = "\r\n\r\n"
VERSION = "WARC/1.0"

#: Namespaces of record ids, so that a record's id follows from what it is made of.
RESPONSES = uuid.UUID("6d1f3c8e-6a0b-5d0c-9d5a-0e5b1a6f7c01")

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = [first + second for first in _ALPHABET for second in _ALPHABET]

#: The date of responses that bring none.
UNKNOWN_DATE = "1970-01-01T00:00:00Z"

RECORD = "head string, block binary, truncated boolean"

#: Fixed: header fields that derived records take over from their response.
INHERITED = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "X-Source-Id")

_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|noframes)(?=[\s>]).*?(?:</\1(?=[\s>])[^>]*>|\Z)|"
    r"<title(?=[\s>]).*?(?:</title(?=[\s>])[^>]*>|(?=</head[\s>]|<body[\s>])|\Z)",
    re.S | re.I,
)
_BREAKS = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|"
    r"li|main|nav|ol|p|pre|section|table|td|tfoot|th|thead|tr|ul)(?=[\s/>])[^>]*>",
    re.I,
)
_TAGS = re.compile(r"<[/!?a-zA-Z][^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_LINKS = re.compile(r"<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)", re.I)


def sha1_of(content: bytes) -> str:
    """A digest as WARC writes it, in base 32; ten bits make two characters."""
    number = int.from_bytes(hashlib.sha1(content).digest())
    return "sha1:" + "".join([_BASE32[number >> shift & 1023] for shift in range(150, -1, -10)])


def record_id(name: str) -> str:
    """The name-based identifier (version 5) of a record."""
    found = bytearray(hashlib.sha1(RESPONSES.bytes + name.encode()).digest()[:16])
    found[6] = found[6] & 0x0F | 0x50
    found[8] = found[8] & 0x3F | 0x80
    digits = found.hex()
    return f"<urn:uuid:{digits[:8]}-{digits[8:12]}-{digits[12:16]}-{digits[16:20]}-{digits[20:]}>"


def plain_text(page: str) -> str:
    """All text of a page, a line per block.

    Of what can stand in a head only elements that are left out anyway hold text, so
    it does not matter where the head ends.
    """
    lines = []
    for line in _TAGS.sub("", _BREAKS.sub("\n", _HIDDEN.sub(" ", page))).split("\n"):
        words = (html.unescape(line) if "&" in line else line).split()
        if words:
            lines.append(" ".join(words))
    return "\n".join(lines)


def _rows(found: list):
    import pyarrow as pa

    arrays = [
        pa.array([h for h, _, _ in found], pa.string()),
        pa.array([b for _, b, _ in found], pa.binary()),
        pa.array([t for _, _, t in found], pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["head", "block", "truncated"])


def head_of(fields: list[tuple[str, str]]) -> str:
    """The lines of header fields."""
    return LINE.join(f"{name}: {value}" for name, value in fields)


def fields_of(head: str) -> list[tuple[str, str]]:
    """The names and values of header lines, in order; lines without a colon are left out."""
    parts = (line.partition(":") for line in head.split(LINE))
    return [(name, value.strip()) for name, colon, value in parts if colon]


# ---- responses -------------------------------------------------------------


def responses_of(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """One response record per row, an HTTP message with the page as its payload.

    Null pages have an empty payload; a null url becomes ``urn:page:`` and the id.
    Rows that repeat id, url and page give records of one id.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(
        F.col(f"`{page_id}`").cast("string").alias("id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_column}`").cast("string"), F.lit("")).alias("html"),
    )

    def build(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                yield _rows([response(*row) for row in zip(*(part.column(i).to_pylist() for i in range(3)))])

    return rows.mapInArrow(build, RECORD)


def response(page_id: str | None, url: str | None, page: str) -> tuple:
    payload = page.encode()
    target = re.sub(r"\s+", "%20", url) if url else f"urn:page:{page_id or ''}"
    head = LINE.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"))
    block, digest = head.encode() + b"\r\n\r\n" + payload, sha1_of(payload)
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id(f"{page_id}\n{target}\n{digest}")),
        ("WARC-Date", UNKNOWN_DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", sha1_of(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Source-Id", page_id or ""),
    ]
    return head_of(fields), block, False


# ---- files -----------------------------------------------------------------


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC files, in their order within each partition.

    Content-Length is written from the block.  A row's bytes are the record; no
    record is split, and an empty table writes no record.
    """
    length = F.concat(F.lit(f"{LINE}Content-Length: "), F.octet_length("block").cast("string"), F.lit(RECORD_END))
    value = F.concat(F.concat(F.lit(f"{VERSION}{LINE}"), "head", length).cast("binary"), F.col("block")).cast("string")
    writer = records.select(value.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip")
    # The default level takes several times as long for files a fifth smaller.
    writer.option("zlib.compress.level", "BEST_SPEED").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzipped WARC files: head (without Content-Length), block, truncated.

    A record whose block ends before its Content-Length is given as far as it goes and
    marked.  Gzipped files are read by one task each, from the start, so their size
    should be that of a partition.
    """
    ship_package(spark)
    pieces = spark.read.option("lineSep", f"{RECORD_END}{VERSION}{LINE}").text(path)
    pieces = pieces.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"))
    return pieces.mapInArrow(_record_batches, RECORD)


def _record_batches(batches: Iterator) -> Iterator:
    found, held, file, size = [], None, None, 0

    def done():
        head, parts, so_far, length = held
        found.append((head, b"".join(parts)[:length], so_far < length))

    between = f"{RECORD_END}{VERSION}{LINE}".encode()
    for batch in batches:
        for piece, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held is not None:
                head, parts, so_far, length = held
                if of == file and so_far < length:
                    parts += (between, piece)
                    held = head, parts, so_far + len(between) + len(piece), length
                    continue
                done()
                size += so_far
            held, file = _parsed(piece), of
            if size > 8_000_000 or len(found) >= ROWS_AT_A_TIME:
                yield _rows(found)
                found, size = [], 0
    if held is not None:
        done()
    if found:
        yield _rows(found)


def _parsed(piece: bytes) -> tuple:
    """Header lines, what follows them in a list, its length, and how long the block is said to be.

    A length that is no number is as good as none: the block is what is there.
    """
    head, _, block = piece.removeprefix(f"{VERSION}{LINE}".encode()).partition(b"\r\n\r\n")
    lines, length = [], len(block)
    for line in head.decode("utf-8", "replace").split(LINE):
        if line[:15].lower() == "content-length:":
            said = line[15:].strip()
            length = int(said) if said.isascii() and said.isdecimal() else len(block)
        else:
            lines.append(line)
    return LINE.join(lines), [block], len(block), length


# ---- derivatives -----------------------------------------------------------


def derive(records: DataFrame) -> DataFrame:
    """Of each response, a metadata and a conversion record that refer to it.

    Both keep the response's target, date, address and source id.  The metadata holds
    as JSON the HTTP status, the source's headers in order, both digests and their
    check, the title and the links.  The conversion holds the plain text and the
    digest of the payload it was made from.  A digest that does not match, or a
    truncated block, is said in the metadata and does not stop the conversion.  Names of
    fields and media types are taken without regard to case; gzip, deflate and chunked
    bodies are unpacked, one in another encoding or broken gives an empty conversion, and
    the metadata says so.  Records of other types give none.
    """
    ship_package(records.sparkSession)

    def derived(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                found = []
                for head, block, truncated in zip(*(part.column(i).to_pylist() for i in range(3))):
                    found.extend(derivatives(fields_of(head), block, truncated))
                yield _rows(found)

    return records.mapInArrow(derived, RECORD)


def derivatives(fields: list[tuple[str, str]], block: bytes, truncated: bool) -> list[tuple]:
    known = {name.strip().lower(): value for name, value in fields}
    if known.get("warc-type", "").lower() != "response":
        return []
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, payload = b"", block
    status, *lines = head.decode("utf-8", "replace").split(LINE)
    headers = [(n.strip(), v.strip()) for n, c, v in (line.partition(":") for line in lines) if c]
    named = {n.lower(): v.lower() for n, v in reversed(headers)}
    kind = named.get("content-type", "")
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind)
    body = _unpacked(payload, named)
    page = _decoded(body or b"", charset[1] if charset else "utf-8")
    digest = sha1_of(payload)
    title = _TITLE.search(page)
    facts = {
        "status": status,
        "headers": headers,
        "payload_digest": digest,
        "block_digest": sha1_of(block),
        "digests_match": known.get("warc-payload-digest", digest) == digest,
        "truncated": truncated,
        "body_decoded": body is not None,
        "title": " ".join(html.unescape(_TAGS.sub("", title[1])).split()) if title else None,
        "links": [html.unescape(link) for link in _LINKS.findall(page)],
    }
    text = plain_text(page) if "html" in kind or not kind else page
    contents = (
        ("metadata", "application/json", json.dumps(facts, ensure_ascii=False).encode()),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    )
    source = known.get("warc-record-id", "")
    return [
        (
            head_of([
                ("WARC-Type", name),
                ("WARC-Record-ID", record_id(f"{source}\n{name}")),
                ("WARC-Refers-To", source),
                *((n, known[n.lower()]) for n in INHERITED if n.lower() in known),
                ("WARC-Source-Payload-Digest", digest),
                ("WARC-Block-Digest", sha1_of(content)),
                ("Content-Type", kind_of),
            ]),
            content,
            False,
        )
        for name, kind_of, content in contents
    ]


def _unpacked(payload: bytes, headers: dict[str, str]) -> bytes | None:
    """A body without its transfer and content encodings; None if one is unknown or broken.

    What of a broken body comes before the fault is not told from the whole, so it is
    not used.
    """
    if "chunked" in headers.get("transfer-encoding", ""):
        parts, at = [], 0
        while True:
            line = payload.find(b"\r\n", at)
            try:
                length = int(payload[at:line].split(b";")[0], 16) if line >= 0 else -1
            except ValueError:
                length = -1
            if length < 0 or line + 2 + length > len(payload):
                break  # not in chunks, or cut off: as it is
            if length == 0:
                payload = b"".join(parts)
                break
            parts.append(payload[line + 2 : line + 2 + length])
            at = line + 2 + length + 2
    for coding in reversed([c.strip() for c in headers.get("content-encoding", "").split(",")]):
        try:
            if coding in ("gzip", "x-gzip"):
                payload = gzip.decompress(payload)
            elif coding == "deflate":
                try:
                    payload = zlib.decompress(payload)
                except zlib.error:  # without the header that belongs there
                    payload = zlib.decompress(payload, -zlib.MAX_WBITS)
            elif coding not in ("", "identity"):
                return None
        except (OSError, EOFError, zlib.error):
            return None
    return payload


def _decoded(payload: bytes, charset: str) -> str:
    try:
        return payload.decode(charset, "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def record_digests(records: DataFrame) -> DataFrame:
    """Of each record its type, ids, target, digests and block, in plain columns."""

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)\r?$", 1), F.lit(""))

    return records.select(
        field("X-Source-Id").cast("long").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Source-Payload-Digest").alias("payload_digest"),
        field("WARC-Block-Digest").alias("block_digest"),
        F.octet_length("block").cast("long").alias("n_bytes"),
        F.sha2("block", 256).alias("block_sha256"),
        "truncated",
    )
