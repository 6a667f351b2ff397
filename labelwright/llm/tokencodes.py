"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds every id's lowest chunk; a bitmap says whose id goes on, and those ids' next
chunks form level 1, and so on. A rank directory (set bits before each block of 512) turns a place on one level into the
place on the next, so any id is read without decoding others.

A shard is one byte string: header, document index (doc ids, first id of each), levels. Shards are rows of a binary
column in Parquet whose pages aren't compressed, so any store that Spark writes to will do and no page has to be decoded for
an id. ``lookup`` reads single ids of documents; ``read_documents`` reads all.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwright.llm.common import cut, slices
from labelwright.llm.tokenize import encoder

MAGIC, BLOCK = b"DAC1", 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Ids of one shard, give or take a document (documents are whole in a shard).
SHARD_IDS = 1 << 18
#: Parts (files) that a lookup's scan lists at most.
LISTED = 1_000
SHARDS = "part int, seq int, start_in_part long, n_docs int, n_ids long, payload binary"


def encode_ids(ids: np.ndarray) -> bytes:
    """Levels of chunks, bitmaps and directories for non-negative ids below 2**32."""
    rest, levels = np.asarray(ids, np.uint64), []
    while True:
        chunk, rest = (rest & np.uint64(255)).astype(np.uint8), rest >> np.uint64(8)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        ones = _ONES[np.pad(bits, (0, -bits.size % (BLOCK // 8)))].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(struct.pack("<II", chunk.size, ranks.size) + chunk.tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            return struct.pack("<I", len(levels)) + b"".join(levels)
        rest = rest[more]


class Codes:
    """A view of encoded ids: single ids by place, or all of them."""

    def __init__(self, data: bytes, at: int = 0):
        (depth,), at = struct.unpack_from("<I", data, at), at + 4
        self.levels = []
        for _ in range(depth):
            (n, r), at = struct.unpack_from("<II", data, at), at + 8
            size = (n + 7) // 8
            self.levels.append((np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, np.uint8, size, at + n), np.frombuffer(data, "<u4", r, at + n + size)))
            at += n + size + 4 * r
        self.end = at

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places, each by one step a level."""
        at = np.asarray(places, np.int64)
        if at.size and (at.min() < 0 or at.max() >= len(self)):
            raise IndexError("place outside the ids")
        out, still = np.zeros(at.size, np.uint32), np.arange(at.size)
        for level, (chunk, bits, ranks) in enumerate(self.levels):
            out[still] |= chunk[at].astype(np.uint32) << np.uint32(8 * level)
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            at, still = at[on], still[on]
            if not at.size:
                break
            block = at // BLOCK
            rank = ranks[block].astype(np.int64)
            whole = np.arange(BLOCK // 8)
            from_byte = block * (BLOCK // 8)
            inside = from_byte[:, None] + whole
            rank += np.where(inside < (at >> 3)[:, None], _ONES[bits[np.minimum(inside, bits.size - 1)]], 0).sum(1, dtype=np.int64)
            rank += _ONES[bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)].astype(np.int64)
            at = rank
        return out

    def all(self) -> np.ndarray:
        above = None
        for chunk, bits, _ in reversed(self.levels):
            own = chunk.astype(np.uint32)
            if above is not None:
                own[np.unpackbits(bits, count=chunk.size, bitorder="little").astype(bool)] |= above << np.uint32(8)
            above = own
        return above


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    ends = np.cumsum([x.size for x in ids], dtype="<u8")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return MAGIC + struct.pack("<I", len(doc_ids)) + known.tobytes() + names.tobytes() + ends.tobytes() + encode_ids(flat)


def read_shard(payload: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Doc ids, the first place of each document (and the end), and the codes."""
    if payload[:4] != MAGIC:
        raise ValueError("not a shard of token codes")
    (n,) = struct.unpack_from("<I", payload, 4)
    known = np.frombuffer(payload, np.uint8, n, 8)
    names = np.frombuffer(payload, "<i8", n, 8 + n)
    ends = np.frombuffer(payload, "<u8", n, 8 + 9 * n).astype(np.int64)
    docs = [d if k else None for d, k in zip(names.tolist(), known.tolist(), strict=True)]
    return docs, np.concatenate([[0], ends]).astype(np.int64), Codes(payload, 8 + 17 * n)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode whole texts into shards in ascending doc_id order and store them; returns the stored table.

    Documents go to tasks by ranges of doc_id and are sorted there, so (part, seq) orders shards as doc_id does. A null
    doc_id comes first; rows with one doc_id are ordered by a hash of the text, and however many there are, they are dealt over
    tasks; a null text is the end id alone. Other columns are left out whatever their names; an empty table gives no shard. A very
    long text is whole in a shard of its own size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        seq = start = held = 0
        own_docs: list[int | None] = []
        own_ids: list[np.ndarray] = []
        names = ["part", "seq", "start_in_part", "n_docs", "n_ids", "payload"]

        def shard() -> pa.RecordBatch:
            row = [[part], [seq], [start], [len(own_docs)], [held], [shard_bytes(own_docs, own_ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, texts in slices(batch.column(1)):
                for doc_id, ids in zip(doc_ids[a:b], coder.encode(texts), strict=True):
                    own_docs.append(doc_id)
                    own_ids.append(np.append(ids, np.uint16(end_id)))
                    held += ids.size + 1
                    if held >= shard_ids:
                        yield shard()
                        seq, start, held, own_docs, own_ids = seq + 1, start + held, 0, [], []
        if own_docs:
            yield shard()

    order = ["doc_id", "_hash", "_row"]
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = named.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return cut(ordered.mapInArrow(run, SHARDS), "token-codes", compression="none")


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all shards before. What is broadcast has a row for each writing task, whatever the data."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return shards.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def index_of(shards: DataFrame) -> DataFrame:
    """of (doc_id), part, seq, first, n of every document: where it lies, as a stored table of a few numbers a document."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, at, _ = read_shard(payload)
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(at[:-1]), pa.array(np.diff(at))], names=["of", "part", "seq", "first", "n"])

    return cut(shards.select("part", "seq", "payload").mapInArrow(index, "of long, part int, seq int, first long, n long"), "token-index")


def lookup(shards: DataFrame, wanted: DataFrame, pieces: int = 64, index: DataFrame | None = None) -> DataFrame:
    """doc_id, position, token_id for each asked (doc_id, position): one id by the rank directories, whatever the shard's size.

    A position outside its document, and a document that no shard has, get a null. A doc_id that several documents share answers
    for each, and a question asked again is answered again. ``index`` is what ``index_of`` made of the shards, once for many lookups; what is
    asked of one shard goes to it in ``pieces``. Of up to ``LISTED`` asked parts only those are read: their numbers are a filter of the scan.
    """

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, positions, at = batch.column(0)[i].values.flatten()
                ids = read_shard(batch.column(1)[i].as_py())[2].get(at.to_numpy())
                yield pa.RecordBatch.from_arrays([doc_ids, positions, pa.array(ids.astype(np.int64))], names=["doc_id", "position", "token_id"])

    places = index_of(shards) if index is None else index
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position"))
    found = asked.join(places, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    inside = F.coalesce((F.col("position") >= 0) & (F.col("position") < F.col("n")), F.lit(False))
    found = cut(found.withColumns({"_inside": inside, "_row": F.monotonically_increasing_id()}), "asked-tokens")
    inside = F.col("_inside")
    ask = F.struct("doc_id", "position", (F.col("first") + F.col("position")).alias("place"))
    lists = found.filter(inside).groupBy("part", "seq", F.pmod("_row", F.lit(pieces))).agg(F.collect_list(ask).alias("asks"))
    few = [r[0] for r in found.filter(inside).select("part").distinct().limit(LISTED + 1).collect()]
    shards = shards.filter(F.col("part").isin(few)) if len(few) <= LISTED else shards
    read = lists.join(shards.select("part", "seq", "payload"), ["part", "seq"]).select("asks", "payload").mapInArrow(get, "doc_id long, position long, token_id long")
    return read.unionByName(found.filter(~inside).select("doc_id", "position", F.lit(None).cast("long").alias("token_id")))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and middle_id (the id at n_tokens // 2, by random access) of every document, all read
    from the stored shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, at, codes = read_shard(payload)
                data = memoryview(codes.all().astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                middle = codes.get(at[:-1] + np.diff(at) // 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(middle)], names=["doc_id", "start", "n_tokens", "ids_crc32", "middle_id"])

    return with_starts(shards).select("start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, middle_id long")
