"""Media columns: byte payloads as greyscale PNG in binary columns, read back, checked and hashed.

The writer stores 64 samples a row, each row under the filter with the least absolute sum.  The reader checks every
chunk's CRC and the zlib stream's own checksum, undoes all five PNG filters with numpy, and takes a perceptual hash:
the image is averaged down to 32 x 32, and the signs of its lowest 8 x 8 cosine terms against their median are the
hash's 64 bits.  Null text counts as empty, and an empty payload is one row of zeros.  Equal texts give equal media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, store

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, SIDE, LOW = 64, 32, 8
LEVEL = 6
#: The orthogonal cosine basis of a SIDE-long signal, lowest frequencies first.
BASIS = np.sqrt(2 / SIDE) * np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))


def payload_of(text: str | None) -> bytes:
    """The text's UTF-8 bytes and zeros up to a positive multiple of WIDTH."""
    data = (text or "").encode()
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filter_rows(image: np.ndarray) -> bytes:
    """Each row after its filter byte: none, sub or up, whichever has the least sum of absolute differences."""
    image = np.ascontiguousarray(image, np.uint8)
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    above = np.zeros_like(image)
    above[1:] = image[:-1]
    made = np.stack([image, image - left, image - above])
    cost = np.minimum(made, -made).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    out = np.empty((len(image), image.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = made[best, np.arange(len(image))]
    return out.tobytes()


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filter_rows(image), LEVEL)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int = 1) -> np.ndarray:
    """Undo PNG filters; runs of rows under none, sub or up are undone at once."""
    out = np.empty_like(rows)
    count, stride = rows.shape
    above = np.zeros(stride, np.uint8)
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), count] if count else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        kind, part = int(kinds[a]), rows[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.cumsum(part.reshape(b - a, -1, bpp), axis=1, dtype=np.uint8).reshape(b - a, stride)
        elif kind == 2:
            out[a:b] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for r in range(a, b):
                up = (out[r - 1] if r else above).astype(np.int16)
                line = np.zeros(stride, np.int16)
                for x in range(0, stride, bpp):
                    left = line[x - bpp : x] if x else np.zeros(bpp, np.int16)
                    here = up[x : x + bpp]
                    if kind == 3:
                        guess = (left + here) // 2
                    else:
                        corner = up[x - bpp : x] if x else np.zeros(bpp, np.int16)
                        p = left + here - corner
                        pa_, pb, pc = abs(p - left), abs(p - here), abs(p - corner)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, here, corner))
                    line[x : x + bpp] = (rows[r, x : x + bpp] + guess) & 255
                out[r] = line
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[b - 1]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale, grey-alpha, RGB or RGBA image as (rows, columns, channels)."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        (length,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if len(body) != length or struct.unpack_from(">I", data, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"the {kind!r} chunk fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if head is None or not ended:
        raise ValueError("a PNG without head or end")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour not in (0, 2, 4, 6):
        raise ValueError("only plain 8-bit images are read")
    bpp = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * bpp)
    return unfilter(rows[:, 0], rows[:, 1:], bpp).reshape(height, width, bpp)


def _averaged(image: np.ndarray, side: int, axis: int) -> np.ndarray:
    """Box averages over `side` equal spans of an axis, with shares of the samples that a span cuts."""
    n = image.shape[axis]
    edges = np.arange(side + 1) * n / side
    sums = np.concatenate([np.zeros_like(image.take([0], axis)), np.cumsum(image, axis=axis)], axis=axis)
    low = np.minimum(edges.astype(np.int64), n - 1)
    shape = [1] * image.ndim
    shape[axis] = -1
    at = sums.take(low, axis) + image.take(low, axis) * (edges - low).reshape(shape)
    return np.diff(at, axis=axis) * side / n


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits of the low-frequency hash; rounded first, so that equal images agree on every machine."""
    grey = image.astype(np.float64).mean(axis=2) if image.ndim == 3 else image.astype(np.float64)
    small = _averaged(_averaged(grey, SIDE, 0), SIDE, 1)
    terms = np.round(BASIS @ small @ BASIS.T, 6).reshape(-1)
    bits = terms > np.median(terms[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as a stored table with a binary column: doc_id, n_bytes, media; read back from the shared folder."""
    bounded_batches(docs.sparkSession)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len((x or "").encode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([encode_png(payload_of(x)) for x in texts], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return store(rows.mapInArrow(images, "doc_id long, n_bytes long, media binary"), "media", codec="uncompressed")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored images hold, from their bytes alone."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                image = decode_png(data)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
