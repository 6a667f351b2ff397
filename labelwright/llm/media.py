"""Media in binary columns: PNG written and read with zlib and numpy, and low-frequency cosine hashes.

The writer makes 8-bit grey images. The reader walks the chunks, tests each checksum, inflates the image data and
undoes all five row filters. The hash shrinks the image to 32 x 32, takes its cosine transform and keeps one bit for each
of the 8 x 8 lowest frequencies: above the median or not. All of it is a narrow pass over rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
_BASIS = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_encode(pixels: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit grey PNG. Each row takes whichever of the filters none, sub and up leaves the smallest sum."""
    height, width = pixels.shape
    rows = pixels.astype(np.uint8)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    tries = np.stack([rows, sub, up])
    cost = np.abs(tries.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    best = cost.argmin(0)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tries[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Rows without their filters. None and sub need no other row and go at once; the others go in order."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown PNG filter")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for i in np.flatnonzero(kinds >= 2).tolist():
        above, row = out[i - 1] if i else np.zeros_like(above), out[i]
        if kinds[i] == 2:
            row += above
        elif kinds[i] == 3:
            left = 0
            for x, (value, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
                row[x] = left = (value + (left + b) // 2) & 255
        else:
            left = corner = 0
            for x, (value, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
                guess = left + b - corner
                far = (abs(guess - left), abs(guess - b), abs(guess - corner))
                near = left if far[0] <= far[1] and far[0] <= far[2] else b if far[1] <= far[2] else corner
                row[x] = left = (value + near) & 255
                corner = b
    return out


def png_decode(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey PNG; ValueError for a broken signature, chunk, checksum or size."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off PNG chunk")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        own = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(kind + own) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"bad checksum in PNG chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", own)
        elif kind == b"IDAT":
            body.append(own)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("PNG without head or end")
    if head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey PNG without interlace is read")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if raw.size != head[1] * (head[0] + 1):
        raise ValueError("PNG data don't fit its size")
    return _unfilter(raw.reshape(head[1], head[0] + 1))


def _shrink(values: np.ndarray, axis: int) -> np.ndarray:
    """``SIDE`` means along an axis; fewer values than that are repeated."""
    n = values.shape[axis]
    edges = np.arange(SIDE) * n // SIDE
    if n < SIDE:
        return values.take(edges, axis)
    sums = np.add.reduceat(values, edges, axis)
    shape = [1, 1]
    shape[axis] = SIDE
    return sums / np.diff(np.append(edges, n)).reshape(shape)


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine frequencies, but for the mean, exceed their median."""
    small = _shrink(_shrink(pixels.astype(np.float64), 1), 0)
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    low[0] = 0.0
    return np.packbits(low > np.median(low[1:])).tobytes()


#: Bytes of texts or media that are worked on at a time.
BYTES = 1 << 21


def _mapped(rows, batches: Iterator[pa.RecordBatch], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """``rows`` over runs of about ``BYTES`` of each batch's last column, so only a few media are in memory twice; a larger one is a run of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right")))
            part, at = batch.slice(at, stop - at), stop
            got = [rows(*x) for x in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
            columns = list(zip(*got, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def store_texts(docs: DataFrame, width: int = 64) -> DataFrame:
    """Each text's UTF-8 bytes, padded with zeros to a positive multiple of ``width``, as a PNG of that width.

    Returns doc_id, n_bytes, media. A null text counts as empty: one row of zeros. Repeated rows stay repeated;
    a null doc_id is kept; other columns are left out whatever their names; an empty table stays empty. A very long text is one
    tall image: a few times its size in memory, and no image waits for another.
    """

    def row(text: str | None) -> tuple[int, bytes]:
        data = (text or "").encode()
        padded = data + bytes(-len(data) % width or (0 if data else width))
        return len(data), png_encode(np.frombuffer(padded, np.uint8).reshape(-1, width))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _mapped(row, it, ["doc_id", "n_bytes", "media"], [pa.int64(), pa.binary()]), "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Decode ``media``: doc_id, n_bytes, the payload's and the stored form's digests, the hash as binary.

    A null medium gives nulls; a broken one fails the job, since lost samples must not go unseen.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "cosine_hash"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def row(n_bytes: int | None, media: bytes | None) -> tuple:
        if media is None:
            return (n_bytes, *[None] * 6)
        pixels = png_decode(media)
        payload = pixels.tobytes()
        return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(pixels)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(lambda it: _mapped(row, it, names, kinds), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, cosine_hash binary")
