"""Exact top-k by inner product: tiled matrix products, partial selection in each tile, tree merging of the lists.

Vectors are gathered into blocks. A tile is a block of queries against a block of candidates; its scores are one
matrix product, and only each query's k best of the tile leave it. Lists are merged by levels, ``FAN`` tiles' groups at a time,
so no task ever holds all of a query's lists. Nothing is broadcast: blocks of queries travel to the candidates' groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import cut

QUERY_BLOCK, SHARD, FAN = 512, 4096, 8
#: Rows of lists that one merging call holds, about; query blocks whose lists a tile task keeps to merge them itself.
MERGED_ROWS, KEPT = 500_000, 32
_LONG = (1 << 63) - 1
BLOCKS = "block long, dim int, ids binary, rows binary, vectors binary"
LISTS = "node long, query_row long, query_id long, row long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, row (unique), v: components as floor(scale * x), x as double. What is null or not finite takes no part, nor do null ids."""
    x = F.col("embedding").cast("array<double>")
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(e))
    v = F.transform(x, lambda e: F.floor(e * scale))
    return vectors.select(F.col("vec_id").cast("long"), "embedding").filter(whole).select("vec_id", F.monotonically_increasing_id().alias("row"), v.alias("v"))


def _blocks(size: int):
    """Rows of a task as blocks of ``size`` rows and one dimension, sorted by id inside."""

    def block(rows: list[tuple], name: int) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0], r[1]))
        ids, own, vectors = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        packed = [[name], [vectors.shape[1]], [ids.tobytes()], [own.tobytes()], [vectors.tobytes()]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(packed, kinds, strict=True)], names=["block", "dim", "ids", "rows", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault(len(row[2]), [])
                own.append(row)
                if len(own) == size:
                    yield block(held.pop(len(row[2])), row[1])
        for own in held.values():
            yield block(own, own[0][1])

    return run


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while no partial sum can pass 2**53, in int64 while none can pass 2**63, else in
    Python's integers. A score beyond a long is held at its limit."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    if 0 <= most < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if 0 <= most <= _LONG:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k highest scores, ties to the smaller column; -1 pads. Partial selection first, then a small sort."""
    n, m = scores.shape
    if m <= k:
        order = np.argsort(-scores.astype(object) if scores.size and scores.min() == -_LONG - 1 else -scores, axis=1, kind="stable")
        return np.pad(order, ((0, 0), (0, k - m)), constant_values=-1)
    kth = np.partition(scores, m - k, axis=1)[:, m - k]
    out = np.full((n, k), -1)
    for i in range(n):
        above, equal = np.flatnonzero(scores[i] > kth[i]), np.flatnonzero(scores[i] == kth[i])
        chosen = np.concatenate([above, equal[: k - above.size]])
        out[i] = chosen[np.lexsort((chosen, -scores[i][chosen]))]
    return out


def _merged_lists(a: list[np.ndarray], b: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each query of two sets of list columns (node, query_row, query_id, row, vec_id, score)."""
    columns = [np.concatenate(x) for x in zip(a, b, strict=True)]
    _, query, _, row, vec, score = columns
    # Scores go down; the complement of a long never overflows.
    order = np.lexsort((row, vec, ~score, query))
    head = np.append(True, np.diff(query[order]) != 0)
    at = np.arange(order.size)
    keep = order[at - np.maximum.accumulate(np.where(head, at, 0)) < k]
    return [c[keep] for c in columns]


def _tile(k: int):
    def arrays(ids: bytes, rows: bytes, vectors: bytes, dim: int, wide: int) -> tuple[np.ndarray, ...]:
        v = np.frombuffer(vectors, np.int64).reshape(-1, dim) if dim else np.zeros((len(ids) // 8, 0), np.int64)
        return np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.pad(v, ((0, 0), (0, wide - dim)))

    def told(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "query_row", "query_id", "row", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                x = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                wide = max(x["dim"], x["q_dim"])
                qid, qrow, q = arrays(x["q_ids"], x["q_rows"], x["q_vectors"], x["q_dim"], wide)
                cid, crow, c = arrays(x["ids"], x["rows"], x["vectors"], x["dim"], wide)
                scores = _product(q, c)
                at = best(scores, k + 1)  # one more, for the query's own row
                who, _ = np.nonzero(at >= 0)
                col = at[at >= 0]
                keep = crow[col] != qrow[who]
                who, col = who[keep], col[keep]
                columns = [np.full(who.size, x["node"]), qrow[who], qid[who], crow[col], cid[col], scores[who, col]]
                # Tiles of one block of queries that this task has are merged here; the block met longest ago leaves.
                name = x["node"], int(qrow.min(initial=_LONG)), x["q_dim"]
                before = held.pop(name, None)
                held[name] = columns if before is None else _merged_lists(before, columns, k)
                if len(held) > KEPT:
                    yield told(held.pop(next(iter(held))))
        for columns in held.values():
            yield told(columns)

    return run


def _merged(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["query_row", "score", "vec_id", "row"], ascending=[True, False, True, True], kind="stable")
        return pdf[pdf.groupby("query_row").cumcount() < k]

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, query_block: int = QUERY_BLOCK, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best of all other rows, or all if fewer; ties to the smaller vec_id.

    ``is_query`` is a Column over vec_id. Rows that repeat a vec_id are rows of their own: each searches and is found,
    and only its own row is left out. Vectors of other lengths are taken as ending in zeros, so a very long one widens its own block
    only. Equal rows tie in row order. Null vectors, and those with null or non-finite components, take no part; an empty table gives
    no rows; other columns are left out whatever their names.
    """
    spark = vectors.sparkSession
    rows = cut(quantized(vectors, scale), "vectors")
    shards = cut(rows.mapInArrow(_blocks(shard), BLOCKS), "shards")
    asked = rows.filter(is_query)
    n_queries = asked.count()
    queries = asked.repartition(max(1, -(-n_queries // (8 * query_block)))).mapInArrow(_blocks(query_block), BLOCKS)
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Candidates' blocks lie in groups; every block of queries visits every group once. That is the search itself,
    # tile by tile: what travels is blocks, and what a tile leaves is k rows a query.
    left = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "dim", "ids", "rows", "vectors")], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    right = shards.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    tiles = left.join(right, "group").withColumn("node", F.col("group").cast("long"))
    tiles = tiles.select("node", "q_dim", "q_ids", "q_rows", "q_vectors", "dim", "ids", "rows", "vectors")
    lists = tiles.mapInArrow(_tile(k), LISTS)
    # A node's queries are dealt over so many parts that one merging call holds a bounded number of rows, however many queries there are.
    nodes = groups
    while True:
        parts = max(groups, -(-n_queries * k * min(fan, nodes) * 2 // MERGED_ROWS))
        spread = lists.withColumn("_part", F.pmod(F.xxhash64("query_row"), F.lit(parts)).cast("int"))
        lists = spread.groupBy("node", "_part").applyInPandas(lambda pdf: _merged(k)(pdf.drop(columns="_part")), LISTS)
        if nodes <= 1:
            break
        nodes = -(-nodes // fan)
        lists = lists.withColumn("node", F.floor(F.col("node") / fan))
    rank = F.row_number().over(_by_query())
    return lists.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS e, row_number() OVER () AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, c.r, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.r <> c.r
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
