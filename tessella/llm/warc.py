"""WARC archives: one gzip member per record, written and read in sequence."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ARCHIVES = "archive string, content binary"
RECORDS = "archive string, offset long, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean, record_id string"
#: Line ends in a URL, written with a percent sign, and what looks like one, which gets 25 more behind the sign.
LINE_END = re.compile("%((?:25)*)(0D|0A)")
ENDS = {"0D": "\r", "0A": "\n"}


def header_value(url: str) -> str:
    """A URL as one header line; ``header_url`` gives it back."""
    return LINE_END.sub(r"%25\1\2", url).replace("\r", "%0D").replace("\n", "%0A")


def header_url(value: str) -> str:
    return LINE_END.sub(lambda m: f"%{m[1][2:]}{m[2]}" if m[1] else ENDS[m[2]], value)


def page_number(record_id: str | None) -> int | None:
    """The page of an id that ``record`` wrote; none of any other."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def agrees(told: str | None, data: bytes) -> bool:
    """Whether data has the SHA-1 digest that a header tells, in base32 or hexadecimal; one that is absent or of another kind can't be held against it."""
    kind, _, value = (told or "").partition(":")
    return kind.lower() != "sha1" or value.upper() in (sha1_base32(data), hashlib.sha1(data).hexdigest().upper())


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit has the HTTP head alone as its block; its headers tell the full payload's length and digest."""
    block = HTTP + (payload if refers_to is None else b"")
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + header_value(url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(content: bytes | memoryview, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each gzip member, inflated bit by bit; a cut-off last member is an error."""
    content = memoryview(content)
    at = 0
    while at < len(content):
        inflate, out, begin = zlib.decompressobj(31), [], at
        while not inflate.eof:
            chunk = content[at : at + step]
            if not len(chunk):
                raise EOFError(f"gzip member at {begin} is cut off")
            out.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
        yield begin, b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, framed by its Content-Length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode(errors="replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers, name = {}, ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:  # goes on with the line before
            headers[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        headers[name] = value.strip()
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError("record is shorter than its Content-Length")
    return headers, rest[:length]


def write_warc(pages: DataFrame, *, min_revisit_bytes: int = 0, archive_bytes: int = 4 << 20, level: int = 6, broadcast_digests: int = 1_000_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive, content) rows, each content a .warc.gz of about ``archive_bytes``, written to the shared folder.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one with the smallest id is
    the response and the others revisit it; shorter ones are all responses. A null html is an empty payload;
    a null url leaves the header out; a row with a null id is always a response and is never referred to;
    rows that repeat the smallest id are responses too. An empty table gives no archive.

    Equal payloads are found by digest over (digest, id) rows, combined before they are shuffled. Digests that occur twice are
    broadcast, up to ``broadcast_digests`` of them, so that no page moves and a payload that very many pages share is no hot key;
    beyond that they are joined, and Spark may split the hot ones.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.when((F.octet_length("html") >= min_revisit_bytes) & F.col("page_id").isNotNull(), F.sha1("html")))
    first = rows.where("sha is not null").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first)
    if first.count() <= broadcast_digests:
        first = F.broadcast(first)
    rows = rows.join(first, "sha", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        name, size = None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [name], "content": [b"".join(held)]}, pa.schema([("archive", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                payload = html.as_buffer().to_pybytes()
                page_id, refers = page_id.as_py(), refers.as_py()
                digest = sha1_base32(payload)
                deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = deflate.compress(record(page_id, url.as_py(), payload, digest, refers)) + deflate.flush()
                name = name or f"{'' if page_id is None else page_id}-{digest}.warc.gz"
                held.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield out()
                    held, name, size = [], None, 0
        if held:
            yield out()

    return materialize(rows.select("page_id", "url", "html", "refers_to").mapInArrow(pack, ARCHIVES))


def read_warc(archives: DataFrame, *, payload: bool = False, strict: bool = True) -> DataFrame:
    """Records of (archive, content) rows in sequence, with their framing and digests verified.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, also of a revisit.
    ``digest_ok`` is whether the digests of what the record holds agree with its headers; with ``strict`` a record whose
    digests don't is an error. With ``payload`` a
    binary column of that name follows (null for a revisit). A null or empty content has no records; content that
    is cut off or is no WARC is an error.

    Archives of other writers are read too: records of every type are returned under their record_id. page_id and refers_to are null
    where an id is none of ``write_warc``'s; the payload is what follows the HTTP head, of a block that is not HTTP the whole
    block. Where a response's digest is absent its own is computed; a digest of another algorithm is returned as it stands
    and not verified; what a revisit or another record doesn't tell is null.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                if not content.is_valid:
                    continue
                rows: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
                for offset, raw in members(content.as_buffer()):
                    headers, block = parse(raw)
                    kind = headers.get("warc-type", "")
                    http = headers.get("content-type", "").replace(" ", "").lower().startswith("application/http")
                    body = block.partition(b"\r\n\r\n")[2] if http else block
                    told = headers.get("warc-payload-digest")
                    digest = told.removeprefix("sha1:") if told else None
                    ok = agrees(headers.get("warc-block-digest"), block)
                    if kind == "revisit":
                        size = int(headers["warc-payload-length"]) if "warc-payload-length" in headers else None
                    else:
                        ok, size = ok and agrees(told, body), len(body)
                        digest = digest or (sha1_base32(body) if kind == "response" else None)
                    if strict and not ok:
                        raise ValueError(f"digest of the record at {offset} in {archive.as_py()} does not agree")
                    url = headers.get("warc-target-uri")
                    url = None if url is None else header_url(url)
                    record_id = headers.get("warc-record-id")
                    values = [archive.as_py(), offset, kind, page_number(record_id), url, size, digest, page_number(headers.get("warc-refers-to")), ok, record_id]
                    for column, value in zip(rows.values(), [*values, None if kind == "revisit" else body]):
                        column.append(value)
                yield pa.RecordBatch.from_pydict(rows, arrow)

    schema = RECORDS + (", payload binary" if payload else "")
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return archives.select("archive", "content").mapInArrow(unpack, schema)


def warc_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of .warc.gz files in any store that Spark reads; a file is one value, of 2 GB at most."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")
