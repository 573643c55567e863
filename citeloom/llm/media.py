"""Media columns: texts stored losslessly as grey-scale PNG in binary columns, read back with checks, and hashed.

Writing: the bytes, zero-padded to a positive multiple of ``WIDTH``, are the 8-bit samples of an image ``WIDTH`` wide.
Each image takes the one of the filters None and Up whose bytes have the smaller entropy; chunks carry lengths
and CRC-32s. Reading tests the signature, every chunk's length and CRC, the header and the size of the inflated data,
then undoes the row filters (all five kinds) with numpy.

The feature is a low-frequency cosine-transform hash: the image is averaged to ``GRID x GRID`` cells, transformed by a
type-II DCT, and the signs of the ``LOW x LOW`` lowest coefficients against their median are 64 bits, as 16 hex digits.

Both directions run in ``mapInArrow``, image by image; memory is one slice of rows. Null and empty texts are one row of
zeros. Equal texts have equal images and features. Repeated rows are treated alike, null ids kept, an empty table gives
no rows; other columns are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

WIDTH, GRID, LOW = 64, 32, 8
#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class MediaError(ValueError):
    """Bytes that are not a whole and undamaged image of the kinds read here."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _bits(samples: np.ndarray) -> float:
    """Bits that the samples take by their own frequencies."""
    counts = np.bincount(samples.ravel(), minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(samples.size / counts)).sum())


def write_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A grey-scale 8-bit PNG of a matrix of bytes."""
    height, width = samples.shape
    up = samples.copy()
    up[1:] -= samples[:-1]
    kind, rows = min(((0, samples), (2, up)), key=lambda f: _bits(f[1]))
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and content of each chunk, with length and checksum tested."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, kind = 8, b""
    while at < len(data):
        if at + 12 > len(data):
            raise MediaError("chunk header cut short")
        (length,) = struct.unpack_from(">I", data, at)
        kind, end = data[at + 4 : at + 8], at + 8 + length
        if end + 4 > len(data):
            raise MediaError("chunk cut short")
        if zlib.crc32(data[at + 4 : end]) != struct.unpack_from(">I", data, end)[0]:
            raise MediaError(f"checksum of {kind!r} is wrong")
        yield kind, data[at + 8 : end]
        at = end + 4
    if kind != b"IEND":
        raise MediaError("no end chunk")


def _slanted(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A run of rows undone at once, whatever their filters: pixel x of row y needs those of the slanted lines before
    x + y, so every slanted line is one step over all rows."""
    height, width = lines.shape
    pixels = np.zeros((height + 1, width // step + 1, step), np.int16)  # a row above and a pixel to the left
    pixels[0, 1:] = above.reshape(-1, step)
    wanted = lines.reshape(height, -1, step)
    for d in range(height + width // step - 1):
        y = np.arange(max(0, d - width // step + 1), min(height, d + 1))
        x = d - y
        a, b, c = pixels[y + 1, x], pixels[y, x + 1], pixels[y, x]
        p = a + b - c
        pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
        paeth = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        guess = np.choose(kinds[y].astype(np.int64)[:, None], [np.zeros_like(a), a, b, (a + b) // 2, paeth])
        pixels[y + 1, x + 1] = (wanted[y, x] + guess) & 255
    return pixels[1:, 1:].reshape(height, width).astype(np.uint8)


def unfilter(lines: np.ndarray, step: int = 1) -> np.ndarray:
    """Samples from filtered lines, whose first byte names the filter; ``step``: bytes of a pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown row filter")
    y = 0
    while y < len(out):
        if kinds[y] == 0:
            y += 1
        elif kinds[y] == 2:  # a run of Up rows is a running sum
            end = y + 1
            while end < len(out) and kinds[end] == 2:
                end += 1
            out[max(y - 1, 0) : end] = np.cumsum(out[max(y - 1, 0) : end], axis=0, dtype=np.uint8)
            y = end
        else:
            above = out[y - 1] if y else np.zeros(out.shape[1], np.uint8)
            end = y + 1
            if kinds[y] == 1:
                out[y] = np.cumsum(out[y].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
            else:
                while end < len(out) and kinds[end] > 2:
                    end += 1
                out[y:end] = _slanted(kinds[y:end], out[y:end], above, step)
            y = end
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of a grey-scale 8-bit PNG without interlacing; ``MediaError`` for anything else."""
    header, packed = None, []
    for kind, content in chunks(data):
        if header is None and kind != b"IHDR":
            raise MediaError("the header is not first")
        if kind == b"IHDR":
            if len(content) != 13 or header is not None:
                raise MediaError("not one header of 13 bytes")
            header = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            packed.append(content)
        elif not kind[0] & 32 and kind != b"IEND":
            raise MediaError(f"unknown critical chunk {kind!r}")
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not a plain 8-bit grey-scale image")
    width, height = header[:2]
    if not width or not height:
        raise MediaError("an image without samples")
    size, inflate = height * (width + 1), zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(packed), size + 1)  # no more than the header says, whatever the chunks hold
    except zlib.error as error:
        raise MediaError("damaged image data") from error
    if len(raw) != size or not inflate.eof or inflate.unused_data:
        raise MediaError("image data of the wrong length")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    """Rows 0 to LOW - 1 of the type-II DCT of GRID values."""
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * GRID))


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which low-frequency coefficients exceed their median. Images of any size are pooled to ``GRID`` cells a side."""
    cells = samples.astype(float)
    for axis, size in enumerate(samples.shape):
        at = np.arange(GRID) * size // GRID
        if size >= GRID:
            counts = np.diff(np.append(at, size))
            cells = np.add.reduceat(cells, at, axis=axis) / (counts[:, None] if axis == 0 else counts)
        else:
            cells = cells.take(at, axis=axis)
    low = (_cosines() @ cells @ _cosines().T).ravel()
    bits = np.round(low, 6) > np.round(np.median(low), 6)
    return np.packbits(bits).tobytes().hex()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sizes, images = [], []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                sizes.append(len(data))
                samples = np.frombuffer(data + bytes(-len(data) % WIDTH if data else WIDTH), np.uint8)
                images.append(write_png(samples.reshape(-1, WIDTH)))
            yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["id", "n_bytes", "media"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "media"):
            rows = []
            for media in batch.column("media").to_pylist():
                samples = read_png(media)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column("id"), batch.column("n_bytes"), *columns], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def to_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``n_bytes`` and the binary column ``media``, a PNG of the text's UTF-8 bytes."""
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(_encode, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_column)


def media_features(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Digests of the payload read back from ``media`` and its cosine-transform hash."""
    chosen = media.select(F.col(id_column).alias("id"), "n_bytes", "media")
    kind = chosen.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return chosen.mapInArrow(_decode, schema).withColumnRenamed("id", id_column)
