"""k-nearest-neighbour labels on Jaccard distance.

Exact. Queries meet the base in tiles; a task keeps a query's k nearest of what it reads and leaves out blocks whose sizes
allow none nearer. Where a few hundred of many queries show that it pays, an inverted index goes first. Tokens are ordered by how many base rows have them, rarest
first. Base rows that share most of a query's rarest tokens give a first k-th distance, and with it bounds: a row at that distance or nearer has one of the
query's first tokens (all but as many as it would need to share) and a size in a range. If the lists of those tokens are
short, only their rows are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwright.operators.distance import BASE_BLOCK, BOTH_EMPTY, QUERY_BLOCK, Block, blocks, common_tile, jaccard_of, met, tiles, token_sets
from labelwright.tables import stored

#: Rows that a query's rarest tokens may list for its first k-th distance, as a multiple of k; the share of the base that its first
#: tokens may list for the index to be used: comparing a row from a list costs about as much as this many in a tile; and the most rows they
#: may list as a multiple of k, since each row from a list moves two whole sets.
PROBE, LISTED, MOST = 6, 64, 16
#: Pairs up to which all queries go by tiles, and queries that tell whether an index pays above.
FEW_PAIRS, ASKED_FIRST = 1 << 28, 256
#: Base rows up to which every query block meets all of them where it was read: ordering the queries by size would leave out nothing.
FEW_ROWS = BASE_BLOCK
#: Room for the rounding of bounds, on the side of comparing more.
SLACK = 1e-9
TOP = 1 << 62
NEAR = "query_id long, base_id long, distance double"


class _Nearest:
    """The k nearest rows so far of each row of a query block: places, ids and distances, and each row's k-th distance."""

    def __init__(self, q: Block, k: int, both_empty: float):
        self.q, self.k, self.both_empty = q, k, both_empty
        self.at, self.ids, self.d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.kth = np.full(q.ids.size, np.inf)

    def meet(self, b: Block) -> None:
        least, most, n = max(b.sizes.min(), 1), max(b.sizes.max(), 1), np.maximum(self.q.sizes, 1)
        if np.all(1 - np.minimum(np.minimum(n / least, most / n), 1) > self.kth + SLACK):
            return  # no size here allows so small a distance
        common = common_tile(self.q, b)
        # A row at the k-th distance or nearer shares at least this part of both sizes' sum; a little less is asked of rounded numbers.
        part = np.where(np.isfinite(self.kth), (1 - self.kth) / (2 - np.minimum(self.kth, 1)), -1.0) * (1 - 1e-5)
        least = np.multiply.outer(part.astype(np.float32), b.sizes.astype(np.float32))
        least += (part * self.q.sizes - 1e-3).astype(np.float32)[:, None]
        near = common >= least
        if np.count_nonzero(near) > 4 * self.k * n.size and b.ids.size > self.k:  # the tile's own k-th distances first
            whole = jaccard_of(common, self.q, b, self.both_empty)
            near = whole <= np.minimum(self.kth, np.partition(whole, self.k - 1, axis=1)[:, self.k - 1])[:, None]
        x, y = np.nonzero(near)
        shared = common[x, y].astype(np.float64)
        union = self.q.sizes[x] + b.sizes[y] - shared
        d = np.where(union > 0, (union - shared) / np.maximum(union, 1), self.both_empty)
        some = d <= self.kth[x]
        at, ids, d = np.concatenate([self.at, x[some]]), np.concatenate([self.ids, b.ids[y[some]]]), np.concatenate([self.d, d[some]])
        order = np.lexsort((ids, d, at))
        at = at[order]
        place = np.arange(at.size) - np.searchsorted(at, at)
        kept, last = order[place < self.k], order[place == self.k - 1]
        self.kth[at[place == self.k - 1]] = d[last]
        self.at, self.ids, self.d = at[place < self.k], ids[kept], d[kept]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.q.ids[self.at]), pa.array(self.ids), pa.array(self.d)], names=[c.split()[0] for c in NEAR.split(", ")])


def _by_tiles(queries: DataFrame, base: DataFrame, k: int, both_empty: float, few: bool = False) -> DataFrame:
    """query_id, base_id, distance of sets (id, n, hashes, and of queries low and high, sizes of what is near enough): each task's k nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = None
        for fresh, q, b in met(batches):
            if fresh:
                if near:
                    yield near.rows()
                near = _Nearest(q, k, both_empty)
            near.meet(b)
        if near:
            yield near.rows()

    right = base.withColumns({"low": F.col("n"), "high": F.col("n")})
    if few:
        return tiles(blocks(queries, QUERY_BLOCK), blocks(right.coalesce(1), BASE_BLOCK)).mapInArrow(run, NEAR)
    by_size = lambda rows: rows.repartitionByRange("n", "id").sortWithinPartitions("n", "id")
    return tiles(blocks(by_size(queries), QUERY_BLOCK), blocks(by_size(right), BASE_BLOCK)).mapInArrow(run, NEAR)


def _compared(pairs: DataFrame, queries: DataFrame, base: DataFrame) -> DataFrame:
    """query_id, base_id, distance of pairs that share a token, each once, by their whole sets."""
    some = pairs.select("query_id", "base_id").distinct()
    joined = some.join(queries.select(F.col("id").alias("query_id"), F.col("n").alias("a"), F.col("hashes").alias("x")), "query_id").join(base.select(F.col("id").alias("base_id"), F.col("n").alias("b"), F.col("hashes").alias("y")), "base_id")
    common = F.size(F.array_intersect("x", "y"))
    return joined.withColumn("common", common).select("query_id", "base_id", ((F.col("a") + F.col("b") - 2 * F.col("common")) / (F.col("a") + F.col("b") - F.col("common"))).alias("distance"))


class _Search:
    """The tables of one search by an index: lists, query tokens by rarity, thresholds and ways."""

    def __init__(self, queries: DataFrame, base: DataFrame, n_base: int, k: int, tokens: str, few: bool = False):
        self.k, self.tokens, self.queries, self.base = k, tokens, queries, base
        self.lists = self.base.select(F.explode("hashes").alias("hash"), F.col("id").alias("base_id"), F.col("n").alias("n_base"))
        if few:  # of a few queries only the lists that they ask for
            self.lists = self.lists.join(F.broadcast(queries.select(F.explode("hashes").alias("hash")).distinct()), "hash", "left_semi")
        rows_of = self.lists.groupBy("hash").agg(F.count("*").alias("rows"))
        asked = self.queries.select(F.col("id").alias("query_id"), "n", F.explode("hashes").alias("hash")).join(rows_of, "hash", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
        rarest = Window.partitionBy("query_id").orderBy("rows", "hash")
        asked = asked.withColumns({"place": F.row_number().over(rarest), "through": F.sum("rows").over(rarest)})
        self.asked = stored(asked.select("query_id", "n", "hash", "rows", "place", "through"), "query-tokens")
        first = self.asked.filter((F.col("rows") > 0) & (F.col("through") <= PROBE * k))
        # Any k rows bound the k-th distance: those that share most of the rarest tokens, if that is a part worth comparing.
        shared = first.join(self.lists, "hash").groupBy("query_id", "n", "base_id").agg(F.count("*").alias("shared"))
        best = Window.partitionBy("query_id").orderBy(F.desc("shared"), "base_id")
        near = _compared(shared.filter(F.col("shared") * PROBE >= F.col("n")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k), self.queries, self.base)
        ranked = near.groupBy("query_id").agg(F.count("*").alias("r"), F.max("distance").alias("within")).filter(F.col("r") == k)
        bound = self.queries.select(F.col("id").alias("query_id"), "n").join(ranked.select("query_id", "within"), "query_id", "left").withColumn("within", F.coalesce("within", F.lit(1.0)))
        share = 1 - F.col("within")
        bound = bound.withColumns({"first": F.col("n") - F.ceil(share * F.col("n") - SLACK) + 1, "low": F.ceil(share * F.col("n") - SLACK).cast("long"), "high": F.when(share > SLACK, F.floor(F.col("n") / share + SLACK).cast("long")).otherwise(TOP)})
        # Of an end's many tokens the sum of rows is the running sum at the last of them.
        listed = self.asked.select("query_id", "place", "through").join(bound.select("query_id", "first"), "query_id").filter(F.col("place") <= F.col("first")).groupBy("query_id").agg(F.max("through").alias("listed"))
        ways = bound.join(listed, "query_id", "left").withColumn("listed", F.coalesce("listed", F.lit(0).cast("long")))
        self.ways = stored(ways.withColumn("indexed", (F.col("listed") * LISTED <= n_base) & (F.col("listed") <= MOST * k)), "query-ways")

    def by_index(self) -> DataFrame:
        some = self.ways.filter("indexed")
        tokens = self.asked.filter("rows > 0").join(some.select("query_id", "first", "low", "high"), "query_id").filter(F.col("place") <= F.col("first"))
        found = tokens.join(self.lists, "hash").filter((F.col("n_base") >= F.col("low")) & (F.col("n_base") <= F.col("high")))
        near = _compared(found, self.queries, self.base)
        # Rows at distance 1 come by their ids: of the first k at most as many are nearer as were found. Rows without tokens are alike, or are not.
        ids = lambda rows: [r[0] for r in rows.select("id").orderBy("id").limit(self.k).collect()]
        first, empty = ids(self.base), ids(self.base.filter("n = 0"))
        same: Column = F.when((F.col("n") == 0) & F.col("base_id").isin(empty), F.lit(BOTH_EMPTY[self.tokens])).otherwise(1.0)
        # Only queries of no known k-th distance below 1 can need them.
        fill = some.filter("within >= 1").select("query_id", "n", F.explode(F.array(*[F.lit(x).cast("long") for x in sorted({*first, *empty})])).alias("base_id")).select("query_id", "base_id", same.alias("distance"))
        return near.unionByName(fill).groupBy("query_id", "base_id").agg(F.min("distance").alias("distance"))

    def by_tiles(self) -> DataFrame:
        left = self.queries.join(self.ways.filter("NOT indexed").select(F.col("query_id").alias("id"), "low", "high"), "id")
        return _by_tiles(left, self.base, self.k, BOTH_EMPTY[self.tokens])


def _sets(df: DataFrame, base: DataFrame, tokens: str, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Sets of the queries and of the base, and the base's rows. Stored, but for queries of few base rows, which are read once."""
    rows = stored(token_sets(base, tokens, text_col, id_col), "base-sets")
    asked, n_base = token_sets(df, tokens, text_col, id_col), rows.count()
    return asked if n_base <= FEW_ROWS else stored(asked, "query-sets"), rows, n_base


def _pays(queries: DataFrame, base: DataFrame, n_base: int, k: int, tokens: str) -> bool:
    """Whether an index would serve half of the queries, by the first of them in the order of a hash. Results are the same without."""
    if n_base <= FEW_ROWS or queries.count() * n_base <= FEW_PAIRS:
        return False
    few = stored(queries.orderBy(F.xxhash64("id"), "id").limit(ASKED_FIRST), "first-queries")
    told = _Search(few, base, n_base, k, tokens, few=True).ways.agg(F.avg(F.col("indexed").cast("int"))).first()[0]
    return told >= 0.5


def knn_neighbours(df: DataFrame, base: DataFrame, k: int = 5, tokens: str = "ws", text_col: str = "text", id_col: str = "row_id", label_col: str = "label") -> DataFrame:
    """query_id, rank, distance, base_id, label of each row's k nearest base rows, ties to the smaller base id.

    No row gets an answer if k is 0 or above the base's size.
    """
    labels = base.select(F.col(id_col).cast("long").alias("base_id"), F.col(label_col).alias("label"))
    asked, rows, n_base = _sets(df, base, tokens, text_col, id_col) if k > 0 else (None, None, 0)
    if n_base < max(k, 1):
        return df.select(F.col(id_col).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance")).limit(0).join(labels.limit(0))
    if _pays(asked, rows, n_base, k, tokens):
        search = _Search(asked, rows, n_base, k, tokens)
        near = search.by_index().unionByName(search.by_tiles())
    else:
        every = asked.withColumns({"low": F.lit(0).cast("long"), "high": F.lit(TOP).cast("long")})
        near = _by_tiles(every, rows, k, BOTH_EMPTY[tokens], n_base <= FEW_ROWS)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "base_id"))).filter(F.col("rank") <= k)
    return ranked.join(labels, "base_id").select("query_id", "rank", "distance", "base_id", "label")


def knn_ways(df: DataFrame, base: DataFrame, k: int = 5, tokens: str = "ws", text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """query_id, n (tokens), within (a bound of the k-th distance), first (tokens that a nearer row has one of), listed (base rows on their
    lists, repeats counted: the candidates), low and high (sizes of nearer rows), indexed (or else in tiles): what an index does for each query."""
    return _Search(*_sets(df, base, tokens, text_col, id_col), k, tokens).ways


def vote(neighbours: DataFrame, kind: str = "majority") -> DataFrame:
    """query_id, estimated. ``majority``: the commonest label; ``weighted``: the largest sum of 1 / (distance + 1e-5). Ties to the
    label of the nearest, then to the smaller label."""
    weight = F.count("*").cast("double") if kind == "majority" else F.round(F.sum(1 / (F.col("distance") + F.lit(1e-5))), 9)
    votes = neighbours.groupBy("query_id", "label").agg(weight.alias("w"), F.min("rank").alias("r"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("w", -F.col("r"), -F.col("label"))).alias("estimated"))


def classify_knn(df: DataFrame, base: DataFrame, k: int = 5, kind: str = "majority", text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """The rows with ``estimated``, in place of a column of that name; null where there is no answer."""
    found = vote(knn_neighbours(df, base, k, "ws", text_col, id_col), kind)
    return df.drop("estimated").join(found.withColumnRenamed("query_id", id_col), id_col, "left")
