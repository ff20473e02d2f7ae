"""WARC archives: one gzip member per record, written through Spark and read sequentially.

Payloads that occur more than once are stored once: the page with the smallest id is a
response record, the others are revisit records that name it and hold its headers only.

Archives are plain ``.warc.gz`` content. Tasks put members together up to ``ARCHIVE_BYTES`` and
Spark's text writer commits each archive as a file of its own, so lost tasks leave nothing and
any file system that Spark knows will do. That writer ends each row with a separator; an
empty gzip member serves, which adds no bytes to what is unpacked.

The reader takes an archive as a stream: it inflates a piece at a time, frames the block by
Content-Length, expects the member to end with its record, and checks both digests on the way.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote
from uuid import UUID, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators.joins import lookup_join
from corpuslab.session import materialize

# Record format.
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDS = UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "1970-01-01T00:00:00Z"
LINE = b"\r\n"
RESPONSE, REVISIT = "response", "revisit"

ARCHIVE_BYTES = 1 << 25
PIECE = 1 << 16
MOST_HEADER_BYTES = 1 << 20
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


class WarcError(ValueError):
    """An archive that does not hold what its records say."""


def base32_sha1(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _record_id(page: str | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid5(IDS, f'{page}' if page is not None else f'no page {url}')}>"


def member(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None, date: str = DATE) -> bytes:
    """One record as a gzip member; a revisit of page ``first`` unless that is None.

    Ids are text. The URL is percent-encoded where it could break a header line.
    """
    http = LINE.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8",
                      b"Content-Length: %d" % len(payload), b"", b""])
    block = http if first is not None else http + payload
    fields = {
        "WARC-Type": RESPONSE if first is None else REVISIT,
        "WARC-Record-ID": _record_id(page, url),
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else None,
        "WARC-Page-ID": quote(page, safe="") if page is not None else None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(hashlib.sha1(block))}",
        "WARC-Refers-To": _record_id(first, None) if first is not None else None,
        "WARC-Refers-To-Page-ID": quote(first, safe="") if first is not None else None,
        "WARC-Profile": IDENTICAL if first is not None else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items() if v is not None), b"", b""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(LINE.join(head)) + packer.compress(block) + packer.compress(LINE + LINE) + packer.flush()


class _Members:
    """Unpacked bytes of one gzip member after another, a piece at a time."""

    def __init__(self, source: BinaryIO):
        self.source, self.packed = source, b""
        self.inflate = None

    def begin(self) -> bool:
        """Go to the next member; False at the end of the source."""
        self.packed = self.packed or self.source.read(PIECE)
        self.inflate = zlib.decompressobj(31) if self.packed else None
        return self.inflate is not None

    def piece(self, most: int = PIECE) -> bytes:
        """Up to ``most`` more bytes of this member; none at its end."""
        while not self.inflate.eof:
            self.packed = self.packed or self.source.read(PIECE)
            if not self.packed:
                raise WarcError("the archive ends inside a record")
            try:
                found = self.inflate.decompress(self.packed, most)
            except zlib.error as error:
                raise WarcError(f"broken gzip member: {error}") from error
            self.packed = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if found:
                return found
        return b""


@dataclass
class Record:
    """One record: its header fields by lower-case name, and of its block what was asked for."""

    fields: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None

    @property
    def kind(self) -> str:
        return self.fields["warc-type"]


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def records(source: BinaryIO, keep: bool = True) -> Iterator[Record]:
    """Records of an archive in order; with ``keep`` their payloads, else only size and digest.

    Of a revisit these two are what its headers say of the page it stands for. Raises
    :class:`WarcError` where framing, gzip data or a digest is wrong. Empty members are skipped.
    """
    members = _Members(source)
    while members.begin():
        held = b""
        while LINE + LINE not in held:
            more = members.piece()
            if not more:
                break
            held += more
            if len(held) > MOST_HEADER_BYTES + PIECE:
                raise WarcError("a record's header does not end")
        if not held:
            continue
        head, end, held = held.partition(LINE + LINE)
        if not end or not head.startswith(b"WARC/"):
            raise WarcError("a gzip member does not begin with a record")
        yield _record(members, _fields(head), held, keep)


def _record(members: _Members, fields: dict[str, str], held: bytes, keep: bool) -> Record:
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise WarcError("a record has no Content-Length")
    left = int(size)
    block, payload = hashlib.sha1(), hashlib.sha1()
    kept, http, n_payload = [], b"", 0
    has_http = fields.get("content-type", "").startswith("application/http")
    in_payload = not has_http
    while left:
        held = held or members.piece()
        if not held:
            raise WarcError("a block is shorter than its Content-Length")
        part, held = held[:left], held[left:]
        left -= len(part)
        block.update(part)
        if not in_payload:
            http += part
            if LINE + LINE not in http:
                continue
            http, _, part = http.partition(LINE + LINE)
            in_payload = True
        payload.update(part)
        n_payload += len(part)
        if keep:
            kept.append(part)
    while more := members.piece():
        held += more
        if len(held) > len(LINE + LINE):
            break
    if held != LINE + LINE:
        raise WarcError("a gzip member does not end with its record")
    _verify(fields, "warc-block-digest", block)
    if fields.get("warc-type") == REVISIT:
        inner = _fields(http)
        stated = inner.get("content-length", "")
        return Record(fields, int(stated) if stated.isdigit() else -1,
                      fields.get("warc-payload-digest", "").removeprefix("sha1:"), None)
    _verify(fields, "warc-payload-digest", payload)
    return Record(fields, n_payload, base32_sha1(payload), b"".join(kept) if keep else None)


def _verify(fields: dict[str, str], name: str, found) -> None:
    stated = fields.get(name)
    if stated is not None and stated.startswith("sha1:") and stated != f"sha1:{base32_sha1(found)}":
        raise WarcError(f"{name} is {stated}, found {base32_sha1(found)}")


def planned(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, url, html, first) of each page; ``first`` is the page it revisits, null for responses.

    Of pages with equal payloads of at least ``least_bytes`` bytes the smallest id responds; pages
    that repeat that id respond too, as do all pages of a payload without any id. A null
    payload counts as empty. Payloads are told apart by SHA-256. Only digests are grouped; the
    table of repeated ones is broadcast while it is small, else hot payloads are split.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), body.alias("html"),
                        F.when(F.octet_length(body) >= least_bytes, F.sha2(body, 256)).alias("own"))
    again = rows.where("own is not null").groupBy("own").agg(F.min("id").alias("smallest"), F.count("*").alias("n"))
    again = materialize(again.where("n > 1"), "repeated-payloads")
    joined = lookup_join(rows, again, "own", "n", "id")
    again_of = F.when(~F.col("id").eqNullSafe(F.col("smallest")), F.col("smallest"))
    return joined.select("id", "url", "html", again_of.alias("first"))


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html",
          least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    """Write one record per page to archives in ``path``, as decided by :func:`planned`.

    An archive ends once it has ``archive_bytes``; a task holds one archive and one page. An
    empty table gives no records, repeated rows as many records as they are.
    """
    text_ids = planned(pages, id, url, html, least_bytes).select(
        F.col("id").cast("string"), "url", "html", F.col("first").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

        for batch in batches:
            html = batch.column("html")
            for i, (page, url, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "url", "first")))):
                payload = html[i].as_buffer().to_pybytes()
                held.append(member(page, url, payload, base32_sha1(hashlib.sha1(payload)), first, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    # the text writer puts out a row's bytes as they are, and the bytes of the separator after it
    text_ids.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option(
        "lineSep", _EMPTY_MEMBER.decode("iso-8859-1")).option("compression", "none").text(path)


READ = ("record_id string, record_type string, target_uri string, date string, page_id string, refers_to string, "
        "payload_bytes long, payload_digest string")


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record of the archives in ``path``, with the payload if asked for.

    Archives may come from elsewhere; records without page ids have null there, record types
    other than response and revisit come as they are. A task reads one archive after another
    and needs the memory of one packed archive (2 GB at most), and of one payload if these
    are asked for. A wrong digest or broken framing ends the job with :class:`WarcError`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for r in records(io.BytesIO(content.as_buffer()), keep=payload):
                    f = r.fields
                    page, first = f.get("warc-page-id"), f.get("warc-refers-to-page-id")
                    rows.append((
                        f.get("warc-record-id"), r.kind, f.get("warc-target-uri"), f.get("warc-date"),
                        page if page is None else unquote(page), first if first is None else unquote(first),
                        r.payload_bytes, r.payload_digest, *[r.payload] * payload))
                    size += len(r.payload or b"")
                    if len(rows) >= 4096 or size > 1 << 24:
                        yield _batch(rows, payload)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, payload)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, READ + ", payload binary" * payload)


def _batch(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    types = [pa.string()] * 6 + [pa.int64(), pa.string()] + [pa.binary()] * payload
    names = re.findall(r"(\w+) (?:string|long)", READ) + ["payload"] * payload
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
