"""Sequences for training, packed by power-of-two decomposition.

A document of n ids is cut into pieces of ``longest`` ids and then into the powers of two of n's remainder,
largest first. Every piece is a sequence by itself and pieces of one length form a bucket, so a batch taken
from a bucket has no padding and no sequence holds ids of two documents. The work is one narrow pass: no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import slices
from labelwright.llm.tokenize import encoder

#: Bytes of text encoded at a time, and stretches that a worker keeps: what an encoder takes beside a full heap stays small.
BYTES, KEPT = 1 << 20, 500_000
#: ids is little-endian unsigned 32-bit.
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, ids_crc32 long"


def cuts(n: int, longest: int) -> list[int]:
    """The piece lengths of n ids: as many of ``longest`` as fit, then the remainder's powers of two, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, longest: int = 1024, with_ids: bool = True) -> DataFrame:
    """One row for each piece of each document, with its bucket (its length) and its own ``sequence_id``.

    A null or empty text is the end id alone. Rows that repeat a doc_id, or have none, are packed as documents of
    their own. Other columns are left out, whatever their names. ``longest`` must be a power of two. An empty table gives no piece; a very
    long text is encoded and cut whole, in a few times its size.
    A sequence id is the task's number and a count in it: gap-free numbers would need a sort that nothing uses.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, KEPT)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, texts in slices(batch.column(1), BYTES):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc_id, ids in zip(doc_ids[a:b], coder.encode(texts), strict=True):
                    data = memoryview(np.append(ids, np.uint16(end_id)).astype("<u4").tobytes())
                    n, start = len(ids) + 1, 0
                    for length in cuts(n, longest):
                        own = data[4 * start : 4 * (start + length)]
                        for column, value in zip(out, (doc_id, start, length, n, bytes(own) if with_ids else None, zlib.crc32(own)), strict=True):
                            column.append(value)
                        start += length
                kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32"])

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store the sequences with a folder for each length, ready for a reader that batches equal lengths."""
    pieces.write.partitionBy("bucket").parquet(path)
