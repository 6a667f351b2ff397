"""Jaccard distances of token sets, in tiles.

Rows are gathered into blocks that list, for each hashed token, the rows that have it. A tile is a block against a block. Of tokens that both have,
those of many rows are counted by one product of 0/1 matrices, those of few by their pairs of rows, so a word that half of all messages have makes no
pairs of its own. Blocks are stored once and tasks read a range of either side, so no block is shuffled or kept twice, and a task's Python process reads each once. Only
what the caller keeps of a tile (the k nearest, or distances below 1) leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.text import tokens_ascii, tokens_ws
from labelwright.tables import stored

QUERY_BLOCK, BASE_BLOCK = 1024, 2048
#: Tokens of a block, give or take a row: long texts make blocks of few rows, so a tile's tables stay small.
BLOCK_TOKENS = 1 << 18
#: A token is counted by the product if its pairs of rows are more than this part of the tile's: a pair costs about as much as this many products.
DENSE = 512
#: Row ids and sizes; tokens ascending, how many rows have each, and which; the least and the greatest bound.
BLOCK = "ids binary, sizes binary, hashes binary, held binary, owners binary, low long, high long"
KINDS = {"ids": np.int64, "sizes": np.int64, "hashes": np.int64, "held": np.int32, "owners": np.int16}
#: Blocks are rows of up to some megabytes: row groups end at four, so that tasks read ranges of a file.
ROW_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
TOKENS = {"ws": tokens_ws, "ascii": tokens_ascii}
#: The distance of two rows without tokens, by kind of token.
BOTH_EMPTY = {"ws": 0.0, "ascii": 1.0}


def token_sets(df: DataFrame, tokens: str = "ws", text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """id, n (how many different tokens), hashes (of them, ascending)."""
    made: Column = TOKENS[tokens](F.col(text_col))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.array_sort(F.transform(made, lambda x: F.xxhash64(x))).alias("hashes"))
    return rows.select("id", F.size("hashes").cast("long").alias("n"), "hashes")


def built(ids: np.ndarray, sizes: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, ...]:
    """A block's numbers (``KINDS``) of rows' ids and sizes and their tokens, one row after another."""
    owner = np.repeat(np.arange(ids.size, dtype=np.int16), sizes)
    order = np.argsort(every, kind="stable")
    hashes, rows = np.unique(every, return_counts=True)
    return ids, sizes, hashes, rows.astype(np.int32), owner[order]


def _block(held: list[tuple[int, np.ndarray, int, int]]) -> pa.RecordBatch:
    parts = built(np.array([h[0] for h in held], np.int64), np.array([h[1].size for h in held], np.int64), np.concatenate([h[1] for h in held]))
    ends = min(h[2] for h in held), max(h[3] for h in held)
    return pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()], pa.binary()) for x in parts], *[pa.array([x], pa.int64()) for x in ends]], names=[*KINDS, "low", "high"])


def blocks(sets: DataFrame, size: int) -> DataFrame:
    """Rows (id, hashes, low, high) in blocks of at most ``size``, stored; a block's low and high are its rows' least and greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, int, int]] = []
        tokens_held = 0
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ids, low, high = (batch.column(c).to_pylist() for c in (0, 2, 3))
            for i in range(batch.num_rows):
                held.append((ids[i], values[ends[i] : ends[i + 1]].astype(np.int64, copy=True), low[i], high[i]))
                tokens_held += held[-1][1].size
                if len(held) == size or tokens_held >= BLOCK_TOKENS:
                    yield _block(held)
                    held, tokens_held = [], 0
        if held:
            yield _block(held)

    return stored(sets.select("id", "hashes", "low", "high").mapInArrow(run, BLOCK), "blocks", **ROW_GROUPS)


def tiles(queries: DataFrame, base: DataFrame) -> DataFrame:
    """Every stored block of queries beside each stored block of the base that overlaps its bounds: a task reads a range of either side.

    A task is told a block's numbers once: a query block's beside the range's first of the base, and those beside the first query block. These
    are met whatever their bounds.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    left, right = (t.select(*[F.col(c).alias(f"{p}_{c}") for c in t.columns], place.alias(f"{p}_at")) for t, p in ((queries, "q"), (base, "b")))
    first = (F.col("q_at") == 0) | (F.col("b_at") == 0)
    pairs = left.hint("shuffle_replicate_nl").join(right, ((F.col("b_high") >= F.col("q_low")) & (F.col("b_low") <= F.col("q_high"))) | first)
    told = [F.when(F.col(f"{o}_at") == 0, F.col(f"{p}_{n}")).alias(f"{p}_{n}") for p, o in ("qb", "bq") for n in KINDS]
    return pairs.select("q_at", "b_at", *told)


@dataclass
class Block:
    """Rows' ids and sizes; tokens, how many rows hold each, where its rows start in ``owners``."""

    ids: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray
    held: np.ndarray
    owners: np.ndarray

    def __post_init__(self):
        self.start = np.cumsum(self.held, dtype=np.int64) - self.held


def across(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: which of them, and the place within it, of each of their sum."""
    which = np.repeat(np.arange(n.size), n)
    return which, np.arange(which.size) - np.repeat(np.cumsum(n) - n, n)


def _has(block: Block, tokens: np.ndarray) -> np.ndarray:
    """0/1 of rows by tokens (places in the block's list)."""
    out = np.zeros((block.ids.size, tokens.size), np.float32)
    column, at = across(block.held[tokens])
    out[block.owners[block.start[tokens][column] + at], column] = 1
    return out


def _rare(q: Block, b: Block, of_q: np.ndarray, of_b: np.ndarray, width: int) -> np.ndarray:
    """Places in a tile of ``width`` columns, one for each pair of rows of these tokens (places in the blocks' lists)."""
    order = np.argsort(b.held[of_b], kind="stable")
    of_q, of_b = of_q[order], of_b[order]
    token, at = across(q.held[of_q])
    row = q.owners[q.start[of_q][token] + at].astype(np.int64) * width
    first, times = b.start[of_b][token], b.held[of_b][token]
    out = np.empty(int(times.sum(dtype=np.int64)), np.int64)
    cuts = np.flatnonzero(np.diff(times)) + 1
    done = 0
    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), times.size], strict=True):  # tokens of as many rows each
        n = int(times[x])
        part = out[done : done + (y - x) * n].reshape(y - x, n)
        part[...] = b.owners[first[x:y, None] + np.arange(n)]
        part += row[x:y, None]
        done += part.size
    return out


def common_tile(q: Block, b: Block) -> np.ndarray:
    """How many tokens rows of two blocks share (queries x base): whole numbers as float32."""
    n_q, n_b = q.ids.size, b.ids.size
    if not q.hashes.size or not b.hashes.size:
        return np.zeros((n_q, n_b), np.float32)
    at = np.minimum(np.searchsorted(q.hashes, b.hashes), q.hashes.size - 1)
    of_b = np.flatnonzero(q.hashes[at] == b.hashes)
    of_q = at[of_b]
    pairs = q.held[of_q].astype(np.int64) * b.held[of_b]
    dense = pairs * DENSE > n_q * n_b
    common = _has(q, of_q[dense]) @ _has(b, of_b[dense]).T  # sums of ones, whole below 2 ** 24
    if not dense.all():
        common += np.bincount(_rare(q, b, of_q[~dense], of_b[~dense], n_b), minlength=n_q * n_b).reshape(n_q, n_b)
    return common


def jaccard_tile(q: Block, b: Block, both_empty: float) -> np.ndarray:
    """Distances (queries x base) of two blocks."""
    return jaccard_of(common_tile(q, b), q, b, both_empty)


def jaccard_of(common: np.ndarray, q: Block, b: Block, both_empty: float) -> np.ndarray:
    """The same of what rows share. One division of whole numbers a pair: exact to the last bit."""
    union = (q.sizes[:, None] + b.sizes[None, :]) - common.astype(np.float64)
    if q.sizes.size and b.sizes.size and q.sizes.min() + b.sizes.min() == 0:
        return np.where(union > 0, (union - common) / np.maximum(union, 1), both_empty)
    return (union - common) / union


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, Block, Block]]:
    """(whether the query block is another than before, query block, base block) of a task's tiles."""
    last, q, base = -1, None, {}
    for batch in batches:
        ats = [batch.column(n).to_pylist() for n in ("q_at", "b_at")]
        read = lambda p, i, batch=batch: Block(*[np.frombuffer(batch.column(f"{p}_{n}")[i].as_py(), kind) for n, kind in KINDS.items()])
        for i, (at, b_at) in enumerate(zip(*ats, strict=True)):
            fresh = at != last
            if fresh:
                last, q = at, read("q", i)
            if at == 0:
                base[b_at] = read("b", i)
            yield fresh, q, base[b_at]


def pairwise_distances(df: DataFrame, tokens: str = "ws", dense: bool = False, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """i, j, distance of all i < j; without ``dense`` only pairs below 1 (every other distance is 1)."""
    every = token_sets(df, tokens, text_col, id_col).withColumns({"low": F.lit(0).cast("long"), "high": F.lit(0).cast("long")})
    both_empty = BOTH_EMPTY[tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, b in met(batches):
            d = jaccard_tile(q, b, both_empty)
            x, y = np.nonzero((q.ids[:, None] < b.ids[None, :]) & (dense | (d < 1)))
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[x]), pa.array(b.ids[y]), pa.array(d[x, y])], names=["i", "j", "distance"])

    return tiles(blocks(every, QUERY_BLOCK), blocks(every, BASE_BLOCK)).mapInArrow(run, "i long, j long, distance double")
