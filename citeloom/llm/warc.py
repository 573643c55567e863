"""WARC archives with Zstandard: written by Spark tasks into a shared folder, and read back with checks.

An archive begins with a skippable frame that holds the dictionary (after the public .warc.zst convention); then comes
one frame a record. The reader loads that dictionary, decodes frame by frame and validates the version line, the
required headers, the content length, the block and payload digests and the blank lines that end a record.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the smallest id is a response, the others are
revisits that name it and carry no payload. Which id that is comes from a map-side combined minimum over digests and a
join whose hot digests AQE can split.

The dictionary is trained on a bounded sample of ``sample_rows`` payloads; too small a sample gives archives without a
dictionary. A task writes an archive under a name of its partition and attempt and reports it in the manifest, so a
repeated attempt leaves at worst an unlisted file. Archives are read through Spark's binary file source.

Null payloads are empty. Repeated rows: rows with the smallest id are all responses, and each row has its record. Rows
with a null id never lend their id to a revisit; if a payload has no other rows, all of them are responses. An empty
table gives no archives and no records. Ids that are no whole numbers are refused. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._shared import materialise, sampled, shared_dir

LEAST = 100
#: Fixed by the .warc.zst convention and the Zstandard format.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
#: What a revisit record says of itself; fixed by the standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of records without one of their own: archives of equal pages are then equal.
DATE = datetime(2000, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class ArchiveError(ValueError):
    """An archive that is cut short, damaged or not of this form."""


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (``payload`` None) has an empty block and tells size and digest of the full payload."""
    block = payload if payload is not None else b""
    headers = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(size)),
        ("WARC-Block-Digest", f"sha256:{digest if payload is not None else hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(block))),
    ]
    if payload is None:
        headers[2:2] = [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"", block, b"", b""])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, validated."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] != VERSION:
        raise ArchiveError("no WARC version line or end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(": ")
        if not colon:
            raise ArchiveError(f"header without a value: {line!r}")
        headers[name.lower()] = value
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ArchiveError(f"headers are missing: {sorted(missing)}")
    if headers["warc-type"] == "revisit" and headers.get("warc-profile") != PROFILE:
        raise ArchiveError("a revisit without its profile")
    if not headers["content-length"].isdigit():
        raise ArchiveError("content length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError("content length does not fit the record")
    block = rest[:size]
    if "sha256:" + hashlib.sha256(block).hexdigest() != headers.get("warc-block-digest"):
        raise ArchiveError("block digest is wrong")
    return headers, block


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, one frame each, after the dictionary in its leading skippable frame."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        (size,) = struct.unpack_from("<I", data, 4)
        at = 8 + size
        if at > len(data):
            raise ArchiveError("dictionary is cut short")
        held = data[8:at]
        if held[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be compressed
            held = zstandard.ZstdDecompressor().decompress(held)
        dictionary = zstandard.ZstdCompressionDict(held)
    opened = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        frame = opened.decompressobj()
        try:
            out = [frame.decompress(view[at : at + (1 << 16)])]
            used = min(len(data), at + (1 << 16))
            while not frame.eof and used < len(data):
                out.append(frame.decompress(view[used : used + (1 << 16)]))
                used = min(len(data), used + (1 << 16))
        except zstandard.ZstdError as error:
            raise ArchiveError(f"damaged frame at byte {at}") from error
        if not frame.eof:
            raise ArchiveError("last frame is cut short")
        at = used - len(frame.unused_data)
        yield parse(b"".join(out))


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str, dictionary: bytes, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of this task's rows, each of about ``most`` bytes; gives their names."""
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    task = TaskContext.get()
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
    out, names, written = None, [], 0
    for batch in batches:
        for page_id, url, html, digest, size, refers_to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "digest", "size", "refers_to")), strict=True):
            if out is None:
                names.append(f"{task.partitionId():06d}-{len(names):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst")
                out, written = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                out.write(archive_head(dictionary))
            frame = packer.compress(record(page_id, url, html, digest, size, refers_to))
            out.write(frame)
            written += len(frame)
            if written >= most:
                out.close()
                out = None
    if out is not None:
        out.close()
    yield pa.record_batch([pa.array(names, pa.string())], names=["name"])


def _number(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows = []
            for headers, block in read_archive(content):
                digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["warc-payload-length"])
                kind = headers["warc-type"]
                if kind == "response" and (len(block) != size or headers["warc-payload-digest"] != headers["warc-block-digest"]):
                    raise ArchiveError(f"payload and headers differ in {path}")
                refers_to = _number(headers["warc-refers-to"]) if kind == "revisit" else None
                rows.append((_number(headers["warc-record-id"]), headers["warc-target-uri"], kind, size, digest, refers_to, block if kind == "response" else None))
                if len(rows) >= 2000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def train_dictionary(pages: DataFrame, payload_column: str = "html", sample_rows: int = 200, size: int = 32 << 10) -> bytes:
    """A Zstandard dictionary trained on at most ``sample_rows`` different payloads; empty if they are too few to train on."""
    filled = pages.where(F.length(payload_column) > 0).select(payload_column)
    rows = sampled(filled, F.col(payload_column), sample_rows, distinct=True).collect()
    try:
        return zstandard.train_dictionary(size, [r[0].encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", most: int = 16 << 20) -> DataFrame:
    """Write a record per row into archives under ``folder``; their paths as the column ``path``. Ids are whole numbers."""
    if not isinstance(pages.schema[id_column].dataType, IntegralType):
        raise TypeError(f"ids are whole numbers, not {pages.schema[id_column].dataType.simpleString()}")
    chosen = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.coalesce(payload_column, F.lit("")).alias("text"))
    payload = F.encode("text", "UTF-8")
    digested = chosen.select("id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    twice = digested.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").select("digest", "least")
    met = F.when(F.col("size") >= LEAST, F.col("digest")).otherwise(F.xxhash64("id", "url", "digest").cast("string"))  # small ones meet nothing
    joined = digested.withColumn("met", met).join(twice.withColumnRenamed("digest", "met"), "met", "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("least")), F.col("least")))
    rows = joined.select("id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "size", "refers_to")
    names = rows.mapInArrow(partial(_write, f"{folder}/archives", train_dictionary(chosen, "text"), most), "name string")
    return materialise(names, folder, "manifest").select(F.concat(F.lit(f"{folder}/archives/"), "name").alias("path"))


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Records of the archives that ``manifest`` lists: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to and payload (null for revisits)."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{folder}/archives")
    names = manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    listed = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(names, "name", "left_semi")
    return listed.select("path", "content").mapInArrow(_read, schema)


def archive_round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Write every row to archives in the shared folder and read the records back."""
    folder = shared_dir(pages.sparkSession)
    return read_archives(pages.sparkSession, folder, write_archives(pages, folder, id_column, url_column, payload_column))
