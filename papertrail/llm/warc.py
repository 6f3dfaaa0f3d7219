"""WARC archives compressed record by record with an embedded dictionary.

Each write task is one archive: it trains a Zstandard dictionary on the
first ``train_bytes`` of the records that it archives, writes the
dictionary in a leading skippable frame (magic 0x184D2A5D), then one frame
per WARC record.  Files are written by Spark's own text writer (the
"lines" are frames, the line separator is an empty skippable frame, which
every Zstandard reader skips), so they go through Spark's file systems and
commit protocol: a retried task replaces its file, nothing is written from
Python, and memory holds ``train_bytes`` of records at most.

Of records with equal payloads of at least ``min_bytes`` bytes (compared
by SHA-256), the one with the smallest id is a response and the others
revisit it; shorter payloads are always responses.  A payload that a third
of all pages share is aggregated on the map side and its revisits carry no
payload.

Defined cases: a null body is empty; a null id ranks last; rows that
repeat the smallest id and its payload are all responses; a null URL has
no target header, control characters in a URL are percent-encoded; extra
columns are ignored; an empty table writes no record.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail.llm.common import small

MIN_BYTES = 100
TRAIN_BYTES = 4 << 20
DICT_BYTES = 64 << 10
LEVEL = 6
MAX_BROADCAST_ROWS = 500_000

# fixed values of the Zstandard and WARC formats
DICT_MAGIC = 0x184D2A5D
SKIP_MAGICS = range(0x184D2A50, 0x184D2A60)
BETWEEN = struct.pack("<II", 0x184D2A50, 0).decode("latin-1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile("[\x00-\x1f\x7f]")


def record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                 min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for a response)."""
    payload = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
                     F.sha2(payload, 256).alias("digest"))
    first = p.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return p.join(small(first.checkpoint(), MAX_BROADCAST_ROWS), "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(later, F.col("first")).alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC 1.1 record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes], size: int):
    """A dictionary of these records; too few of them to train on serve as
    raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, records, k=1024, d=8)
    except zstandard.ZstdError:
        raw = b"".join(records)[:size].ljust(8, b" ")
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   min_bytes: int = MIN_BYTES, train_bytes: int = TRAIN_BYTES, dict_bytes: int = DICT_BYTES,
                   level: int = LEVEL, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one archive per task under ``path``."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held: list[bytes] = []
        held_bytes, press = 0, None

        def begin() -> list[bytes]:
            nonlocal press
            d = trained(held, dict_bytes)
            press = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
            raw = d.as_bytes()
            return [struct.pack("<II", DICT_MAGIC, len(raw)) + raw, *map(press.compress, held)]

        def rows(out: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

        for b in batches:
            out: list[bytes] = []
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4)))):
                page_id, url, digest, refers_to = row
                r = record(page_id, url, b.column(2)[i].as_py(), digest, refers_to, date)
                if press is None:
                    held.append(r)
                    held_bytes += len(r)
                    if held_bytes >= train_bytes:
                        out += begin()
                else:
                    out.append(press.compress(r))
            if out:
                yield rows(out)
        if press is None and held:
            yield rows(begin())

    typed = record_types(pages, id_col, url_col, body_col, min_bytes)
    typed = typed.select("page_id", "url", "payload", "digest", "refers_to")
    typed.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")) \
        .write.option("lineSep", BETWEEN).text(path)


def records_of(archive: bytes) -> Iterator[bytes]:
    """The WARC records of one archive, in order."""
    import zstandard

    view, at, known = memoryview(archive), 0, None
    while at + 8 <= len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIP_MAGICS:
            if magic == DICT_MAGIC:
                known = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8:at + 8 + size])))
            at += 8 + size
            continue
        one = (known or zstandard.ZstdDecompressor()).decompressobj()
        out = []
        while not one.eof:
            part = view[at:at + (1 << 16)]
            if not part:
                raise ValueError("an archive ends within a record")
            out.append(one.decompress(part))
            at += len(part)
        at -= len(one.unused_data)
        yield b"".join(out)


def parsed(rec: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, digest, payload, its length);
    a revisit has no payload of its own."""
    head, _, block = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])

    def page(urn: str | None) -> int | None:
        text = urn and urn.removeprefix("<urn:x-page:").removesuffix(">")
        return None if text in (None, "null") else int(text)

    kind = fields["WARC-Type"]
    return (page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, page(fields.get("WARC-Refers-To")),
            fields["WARC-Payload-Digest"].removeprefix("sha256:"), payload if kind == "response" else None, length)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``: page_id, url, record_type,
    refers_to, digest (as its header says), payload (null for a revisit) and
    payload_bytes."""
    names = ["page_id", "url", "record_type", "refers_to", "digest", "payload", "payload_bytes"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for b in batches:
            for archive in b.column(0):
                out, held = [], 0
                for r in records_of(archive.as_buffer()):
                    out.append(parsed(r))
                    held += len(r)
                    if held > 8 << 20:
                        yield rows(out)
                        out, held = [], 0
                if out:
                    yield rows(out)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, digest string, "
                                 "payload binary, payload_bytes long")
