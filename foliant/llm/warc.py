"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Archives are rows (name, content) of a written table, each of bounded size, so
that a reader of any kind (also ``spark.read.format("binaryFile")``) can hand
them to ``read_archives``. The reader loads the dictionary, decodes one frame
for each record and checks headers, block lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.runtime import broadcast_if_small, materialize

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC, LEVEL, DICTIONARY_BYTES = 0x184D2A5D, 3, 16384
#: Payloads from this many bytes are revisited; an archive is closed behind this many compressed bytes.
REVISIT_BYTES, ARCHIVE_BYTES = 1000, 4 << 20
#: Repeated payloads of which more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
_CHUNK, _NAMESPACE = 1 << 16, uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_DATE = "2000-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive breaks the format."""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def make_record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit without. URLs are percent-encoded where a header can't hold them."""
    uri = "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on the archive's first records; raw content where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:8192] for r in records])
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict((b"".join(r[:1024] for r in records) + b"WARC/1.1\r\n")[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def make_archive(records: Iterator[bytes], limit: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Archives of about ``limit`` bytes from a stream of records."""
    records, first = iter(records), []
    while True:
        for record in records:
            first.append(record)
            if len(first) == 200 or sum(map(len, first)) > limit:
                break
        if not first:
            return
        dictionary = train(first)
        packed = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True).compress(dictionary.as_bytes())
        out = [struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed]
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
        out += [coder.compress(r) for r in first]
        first, size = [], sum(map(len, out))
        while size < limit and (record := next(records, None)) is not None:
            out.append(coder.compress(record))
            size += len(out[-1])
        yield b"".join(out)


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; raises ``ArchiveError`` where the archive breaks the format."""
    view = memoryview(archive)
    if len(view) < 8 or struct.unpack("<I", view[:4])[0] != DICTIONARY_MAGIC:
        raise ArchiveError("no leading dictionary frame")
    at = 8 + struct.unpack("<I", view[4:8])[0]
    if at > len(view):
        raise ArchiveError("dictionary frame is cut off")
    raw = bytes(view[8:at])
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    while at < len(view):
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ArchiveError("last frame is cut off")
            piece = view[at : at + _CHUNK]
            try:
                parts.append(frame.decompress(piece))
            except zstandard.ZstdError as error:
                raise ArchiveError(str(error)) from error
            at += len(piece) - len(frame.unused_data)
        yield parse_record(b"".join(parts))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, validated."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError("header without a colon")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"no {name}")
    size = int(headers["content-length"]) if headers["content-length"].isdigit() else -1
    if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError("wrong length")
    block = rest[:size]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ArchiveError("wrong block digest")
    return headers, block


def describe(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; a response's payload is checked."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    if headers["warc-type"] == "response" and (not gap or len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError("wrong payload")
    page, refers = headers.get("x-page-id") or None, headers.get("x-refers-to-page")
    return (page and int(page), size, digest, headers["warc-type"], refers and int(refers))


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives (name, content) of the pages (page_id, url, html), one record a row, written to the shared folder.

    A null html or url is empty. Of pages with equal payloads of at least
    ``REVISIT_BYTES`` bytes the largest page_id is the response (a null page_id
    is below any other), the others revisit it; of repeated rows with that
    page_id each is a response.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("size") >= REVISIT_BYTES)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = broadcast_if_small(materialize(groups, "warc-groups"), BROADCAST_GROUPS)  # else a merge join, which splits a hot digest
    told = rows.join(groups, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")))
    told = told.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def records():
            for batch in batches:
                for r in batch.to_pylist():
                    yield make_record(r["page_id"], r["url"], r["payload"] or b"", r["digest"], r["size"], r["refers_to"])

        for archive in make_archive(records()):
            name = hashlib.sha1(archive).hexdigest() + ".warc.zst"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive], pa.binary())], names=["name", "content"])

    return materialize(told.mapInArrow(run, "name string, content binary"), "archives")


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """One row for each record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        for batch in batches:
            for archive in batch.column(0):
                rows = [describe(h, b) for h, b in read_records(archive.as_buffer())]
                columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)]
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in kinds])

    return archives.select(content).mapInArrow(run, _SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read them back: one row a page; an empty table gives an empty result."""
    return read_archives(write_archives(pages))
