"""Hierarchical clustering as a labeller.

The linkages built here are reducible, so all pairs of clusters that are each other's nearest may merge in one round and the tree is the same; ties
are broken by a hash of the pair, so a field of equal distances merges many pairs a round. A cluster is named by its smallest member.

Average and complete linkage keep only pairs that share a token: rows of different components of that graph stay at distance 1 and merge
last. Components are units of their own: those of up to ``UNIT_PAIRS`` pairs are merged to the end in one task, several at a time; larger ones
take rounds of joins, each written once, until few enough pairs are left of them. So there is no most rows. Ward's linkage needs all pairs.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwright.operators import matrix
from labelwright.operators.distance import pairwise_distances
from labelwright.operators.knn import knn_neighbours
from labelwright.tables import in_order, stored

METHODS = ("average", "complete", "ward")
#: Rows that Ward's linkage, which keeps all pairs, takes at most, and rows that trees are fitted on where linkages are compared.
FIT_ROWS = 2_000
#: Pairs of a component that one task merges to the end, some 300 bytes each: all pairs of ``FIT_ROWS`` rows are one unit.
UNIT_PAIRS = FIT_ROWS * (FIT_ROWS - 1) // 2
#: Cells of a square of clusters that one task merges, 8 bytes each, for each of those pairs.
ROW_PAIRS = 18
#: Clusters up to which a round broadcasts what it knows of each (a few numbers).
BROADCAST_ROWS = 500_000
NEUTRAL = 2
STATE = "a long, b long, n long, similar double, squares double, far double, size_a long, size_b long, within_a double, within_b double"
MERGES = "turn int, keep1 long, keep2 long, dissimilarity double, size long"


def _dissimilarity(method: str) -> Column:
    """Of clusters a and b from sizes, stored pairs n, and sums of similarity, of squared distance, and the largest distance."""
    size = F.col("size_a") * F.col("size_b")
    if method == "average":
        return 1 - F.col("similar") / size
    if method == "complete":
        return F.when(F.col("n") == size, F.col("far")).otherwise(F.lit(1.0))
    between = (F.col("squares") + (size - F.col("n"))) / size
    within = F.col("within_a") / (F.col("size_a") * F.col("size_a")) + F.col("within_b") / (F.col("size_b") * F.col("size_b"))
    return F.sqrt(F.greatest(F.lit(0.0), 2 * size / (F.col("size_a") + F.col("size_b")) * (between - within / 2)))


def _dissimilar(s: dict[str, np.ndarray], method: str) -> np.ndarray:
    """The same of a task's arrays."""
    size = s["size_a"] * s["size_b"]
    if method == "average":
        return 1 - s["similar"] / size
    if method == "complete":
        return np.where(s["n"] == size, s["far"], 1.0)
    between = (s["squares"] + (size - s["n"])) / size
    within = s["within_a"] / (s["size_a"] * s["size_a"]) + s["within_b"] / (s["size_b"] * s["size_b"])
    return np.sqrt(np.maximum(0.0, 2 * size / (s["size_a"] + s["size_b"]) * (between - within / 2)))


def _mutual(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of pairs that are the first of both their ends: by distance, then a hash of the pair."""
    order = np.round(d, 12)
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    least = np.full(ids.size, np.inf)
    np.minimum.at(least, x, order)
    np.minimum.at(least, y, order)
    near = np.flatnonzero((order == least[x]) & (order == least[y]))  # both ends have nothing nearer
    ties_x, ties_y = (np.bincount(e[order == least[e]], minlength=ids.size) for e in (x, y))
    alone = (ties_x + ties_y)[x[near]] + (ties_x + ties_y)[y[near]] == 2
    sure, rest = near[alone], near[~alone]
    if rest.size:
        # Where distances tie, a pair is first if its hash is the least among those as near, of either end.
        asked = np.zeros(ids.size, bool)
        asked[x[rest]] = asked[y[rest]] = True
        tied = np.flatnonzero((order == least[x]) & asked[x] | (order == least[y]) & asked[y])
        digests = np.frombuffer(b"".join([md5(b"%d|%d" % p).digest() for p in zip(a[tied].tolist(), b[tied].tolist(), strict=True)]), ">u8").reshape(-1, 2)
        own = [(order[tied] == least[e[tied]]) & asked[e[tied]] for e in (x, y)]
        node, row = np.concatenate([x[tied][own[0]], y[tied][own[1]]]), np.concatenate([np.flatnonzero(o) for o in own])
        by = np.lexsort((digests[row, 1], digests[row, 0], node))
        first = np.full(ids.size, -1)
        first[node[by][::-1]] = tied[row[by][::-1]]  # the last one written is the least
        rest = rest[(first[x[rest]] == rest) & (first[y[rest]] == rest)]
    return np.concatenate([sure, rest]).astype(np.int64)


def merge_all(s: dict[str, np.ndarray], method: str, turn: int = 0) -> list[tuple[int, int, int, float, int]]:
    """Rows of ``MERGES`` of some components' pairs, merged round by round until no pair is left."""
    out = []
    while s["a"].size:
        d = _dissimilar(s, method)
        k = _mutual(s["a"], s["b"], d)
        size = s["size_a"][k] + s["size_b"][k]
        within = s["within_a"][k] + s["within_b"][k] + 2 * (s["squares"][k] + s["size_a"][k] * s["size_b"][k] - s["n"][k])
        keep, gone = s["a"][k], s["b"][k]
        out += zip([turn] * k.size, keep.tolist(), gone.tolist(), d[k].tolist(), size.tolist(), strict=True)
        ends = np.concatenate([keep, gone])
        order = np.argsort(ends)
        ends, to, grown, spread = ends[order], np.tile(keep, 2)[order], np.tile(size, 2)[order], np.tile(within, 2)[order]
        for e in "ab":
            at = np.minimum(np.searchsorted(ends, s[e]), ends.size - 1)
            hit = ends[at] == s[e]
            s |= {e: np.where(hit, to[at], s[e]), f"size_{e}": np.where(hit, grown[at], s[f"size_{e}"]), f"within_{e}": np.where(hit, spread[at], s[f"within_{e}"])}
        left = s["a"] != s["b"]
        turned = s["a"] > s["b"]
        s |= {f"{c}{x}": np.where(turned, s[f"{c}{y}"], s[f"{c}{x}"]) for c in ("", "size_", "within_") for x, y in ("ab", "ba")}
        order = np.lexsort((s["b"][left], s["a"][left]))
        s = {c: v[left][order] for c, v in s.items()}
        if s["a"].size:
            head = np.flatnonzero(np.append(True, (np.diff(s["a"]) != 0) | (np.diff(s["b"]) != 0)))
            s = {c: np.add.reduceat(v, head) if c in ("n", "similar", "squares") else np.maximum.reduceat(v, head) if c == "far" else v[head] for c, v in s.items()}
        turn += 1
    return out


def _units(method: str, turn: int):
    columns = [c.split()[0] for c in STATE.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        made = merge_all({c: table.column(c).to_numpy() for c in columns}, method, turn)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        values = list(zip(*made, strict=True)) or [[]] * 5
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in MERGES.split(", ")])

    return run


def _components(pairs: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id of (a, b): least labels of neighbours, then of labels, until nothing changes."""
    ends = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(ends.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "components")
    while True:
        near = ends.join(_small(labels).select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        moved = labels.join(near, "id").join(jump, "component", "left")
        labels = stored(moved.select("id", F.col("component").alias("was"), F.least("near", "component", "further").alias("component")), "components")
        if labels.filter("was <> component").isEmpty():
            return labels.select("id", "component")


def _small(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has up to ``BROADCAST_ROWS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _round(state: DataFrame, method: str) -> DataFrame:
    """One round of joins: the pairs that are left, and those that merged (``merged``, with d and size).

    Least distances by cluster first; only pairs that have one are hashed, to break ties.
    """
    full = state.withColumn("d", _dissimilarity(method)).withColumn("r", F.round("d", 12))
    least = _small(stored(full.select("r", F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.min("r").alias("least")), "least"))
    for s in "ab":
        full = full.join(least.select(F.col("id").alias(s), (F.col("least")).alias(f"least_{s}")), s)
    tied = full.filter("r = least_a OR r = least_b")
    ends = tied.select(F.struct(F.md5(F.concat_ws("|", "a", "b")).alias("h"), "a", "b").alias("order"), F.explode(F.array(F.when(F.col("r") == F.col("least_a"), F.col("a")), F.when(F.col("r") == F.col("least_b"), F.col("b")))).alias("id"))
    best = ends.filter("id IS NOT NULL").groupBy("id").agg(F.min("order").alias("best"))
    mutual = best.groupBy("best").agg(F.count("*").alias("both")).filter("both = 2").select(F.col("best.a").alias("a"), F.col("best.b").alias("b"))
    within = F.col("within_a") + F.col("within_b") + 2 * (F.col("squares") + F.col("size_a") * F.col("size_b") - F.col("n"))
    merged = stored(tied.join(_small(stored(mutual, "mutual")), ["a", "b"]).withColumns({"size": F.col("size_a") + F.col("size_b"), "within": within}).drop("r", "least_a", "least_b"), "merged")
    few = merged.count() <= BROADCAST_ROWS
    moved = state
    for s in "ab":
        new = merged.select(F.explode(F.array("a", "b")).alias(f"of_{s}"), F.col("a").alias(f"to_{s}"), F.col("size").alias(f"grown_{s}"), F.col("within").alias(f"spread_{s}"))
        moved = moved.join(F.broadcast(new) if few else new, F.col(s) == F.col(f"of_{s}"), "left").withColumns({f"to_{s}": F.coalesce(f"to_{s}", s), f"size_{s}": F.coalesce(f"grown_{s}", f"size_{s}"), f"within_{s}": F.coalesce(f"spread_{s}", f"within_{s}")})
    turned = F.col("to_a") > F.col("to_b")
    sides = {f"{c}_{s}": F.when(turned, F.col(f"{c}_{o}")).otherwise(F.col(f"{c}_{s}")) for c in ("to", "size", "within") for s, o in ("ab", "ba")}
    moved = moved.filter("to_a <> to_b").withColumns(sides)
    sums = [F.sum(c).alias(c) for c in ("n", "similar", "squares")] + [F.max(c).alias(c) for c in ("far", "size_a", "size_b", "within_a", "within_b", "component")]
    left = moved.groupBy(F.col("to_a").alias("a"), F.col("to_b").alias("b")).agg(*sums)
    none = F.lit(None)
    return left.select(*state.columns, F.lit(False).alias("merged"), none.cast("double").alias("d"), none.cast("long").alias("size")).unionByName(merged.select(*state.columns, F.lit(True).alias("merged"), "d", "size"))


def linkage(df: DataFrame, method: str = "average", text_col: str = "text", id_col: str = "row_id", fit_rows: int = FIT_ROWS, unit_pairs: int = UNIT_PAIRS) -> DataFrame:
    """step, cluster1, cluster2, new_cluster, dissimilarity, size, and keep1, keep2 (smallest members), in ascending dissimilarity.

    Rows are 0..n-1 in id order, step i makes cluster n+i. Ward's linkage of more than ``fit_rows`` rows is an error: take a sample first.
    """
    if method not in METHODS:
        method = "average"
    rows = stored(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "leaves")
    n = rows.count()
    if method == "ward" and n > fit_rows:
        raise ValueError(f"{n} rows: fit Ward's tree on {fit_rows} at most and label the rest by their nearest")
    if method != "ward" and n * (n - 1) // 2 > unit_pairs:
        rounds = matrix.Rounds(matrix.sets(rows), method)
        if rounds.dense():
            return dendrogram(stored(rounds.merges(math.isqrt(ROW_PAIRS * unit_pairs)), "merges"), rows, n)
    one, none = F.lit(1).cast("long"), F.lit(0.0)
    state = pairwise_distances(rows, "ascii", dense=method == "ward", id_col="id").select(
        F.col("i").alias("a"), F.col("j").alias("b"), one.alias("n"), (1 - F.col("distance")).alias("similar"), (F.col("distance") * F.col("distance")).alias("squares"), F.col("distance").alias("far"),
        one.alias("size_a"), one.alias("size_b"), none.alias("within_a"), none.alias("within_b"))
    state = stored(state, "pairs")
    if method == "ward" or state.count() <= unit_pairs:
        state = state.withColumn("component", F.lit(0).cast("long"))  # few pairs: one unit
    else:
        state = stored(state.join(_small(_components(state)).withColumnRenamed("id", "a"), "a").select(*state.columns, "component"), "pairs")
    tree, turn = None, 0
    while True:
        sizes = stored(state.groupBy("component").agg(F.count("*").alias("pairs")), "component-sizes")
        large = sizes.filter(F.col("pairs") > unit_pairs).select("component")
        small = sizes.filter(F.col("pairs") <= unit_pairs).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] if method != "ward" else state.count()
        if small:
            whole = state if method == "ward" else state.join(large, "component", "left_anti")
            unit = F.pmod(F.xxhash64("component"), F.lit(max(1, 2 * small // unit_pairs)))
            made = stored(whole.withColumn("unit", unit).groupBy("unit").applyInArrow(_units(method, turn), MERGES), "merges")
            tree = made if tree is None else tree.unionByName(made)
        if method == "ward" or large.isEmpty():
            break
        done = stored(_round(state.join(large, "component", "left_semi").select(*state.columns), method), "turn")
        made = done.filter("merged").select(F.lit(turn).alias("turn"), F.col("a").alias("keep1"), F.col("b").alias("keep2"), F.col("d").alias("dissimilarity"), "size")
        tree = made if tree is None else tree.unionByName(made)
        state, turn = done.filter("NOT merged").drop("merged", "d", "size"), turn + 1
    empty = df.sparkSession.createDataFrame([], MERGES)
    return dendrogram(stored(tree if tree is not None else empty, "merges"), rows, n)


def dendrogram(merges: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Merges of pairs below 1 in order, then all that is left, which merges at 1, one cluster after another into the smallest; with the names of
    inner clusters. Numbers and sums in order are taken over ranges, so no task holds the tree."""
    steps = stored(in_order(merges, F.round("dissimilarity", 9), "turn", "keep1", "size", "keep2", rank="step"), "steps")
    made = steps.count()
    leaf = stored(in_order(rows.select("id"), "id", rank="leaf"), "leaf-names")
    grown = steps.groupBy(F.col("keep1").alias("id")).agg(F.max("size").alias("size"), F.max("step").alias("last"))
    tops = leaf.join(steps.select(F.col("keep2").alias("id")), "id", "left_anti").join(grown, "id", "left").select("id", F.coalesce("size", F.lit(1).cast("long")).alias("size"), F.coalesce(F.lit(n) + F.col("last"), F.col("leaf")).alias("name"))
    left = stored(in_order(tops, "id", rank="place", total=("size", "through")), "tops")
    head = left.filter("place = 0").select(F.col("id").alias("keep1"), F.col("name").alias("first")).first()
    # A cluster's name is the last earlier step that it came out of, else its leaf.
    events = steps.select(F.col("keep1").alias("id"), "step", F.lit(1).alias("side"), F.col("step").alias("made")).unionByName(steps.select(F.col("keep2").alias("id"), "step", F.lit(2).alias("side"), F.lit(None).cast("long").alias("made")))
    earlier = Window.partitionBy("id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    named = events.withColumn("last", F.max("made").over(earlier)).join(leaf, "id").withColumn("name", F.coalesce(F.lit(n) + F.col("last"), F.col("leaf")))
    sides = [named.filter(F.col("side") == s).select("step", F.col("name").alias(f"name{s}")) for s in (1, 2)]
    whole = steps.join(sides[0], "step").join(sides[1], "step").select("step", "name1", "name2", "dissimilarity", "size", "keep1", "keep2")
    if head is not None:
        step = F.lit(made) + F.col("place") - 1
        before = F.when(F.col("place") == 1, F.lit(head["first"])).otherwise(F.lit(n) + step - 1)
        last = left.filter("place > 0").select(step.alias("step"), before.alias("name1"), F.col("name").alias("name2"), F.lit(1.0).alias("dissimilarity"), F.col("through").alias("size"), F.lit(head["keep1"]).cast("long").alias("keep1"), F.col("id").alias("keep2"))
        whole = whole.unionByName(last)
    return whole.select(F.col("step").cast("int").alias("step"), F.least("name1", "name2").alias("cluster1"), F.greatest("name1", "name2").alias("cluster2"), (F.lit(n) + F.col("step")).alias("new_cluster"), "dissimilarity", "size", "keep1", "keep2")


def cut(merges: DataFrame, ids: DataFrame, k: int, id_col: str = "row_id") -> DataFrame:
    """row_id, cluster (its smallest member): the first n - k merges done, so k clusters; an error if there are fewer rows."""
    rows = ids.select(F.col(id_col).cast("long").alias("row_id"))
    n = rows.count()
    if k < 1 or n < k:
        raise ValueError(f"{n} rows can't be cut into {k} clusters")
    parents = stored(merges.filter(F.col("step") < n - k).select(F.col("keep2").alias("row_id"), F.col("keep1").alias("cluster")), "parents")
    while True:  # each round doubles the way to the top
        up = parents.select(F.col("row_id").alias("cluster"), F.col("cluster").alias("up"))
        if parents.join(up, "cluster", "left_semi").isEmpty():
            break
        parents = stored(parents.join(up, "cluster", "left").select("row_id", F.coalesce("up", "cluster").alias("cluster")), "parents")
    return rows.join(parents, "row_id", "left").select("row_id", F.coalesce("cluster", "row_id").alias("cluster"))


def cluster_votes(df: DataFrame, membership: DataFrame, label_col: str = "label", id_col: str = "row_id") -> DataFrame:
    return df.select(F.col(id_col).alias("row_id"), F.col(label_col).alias("label")).join(membership, "row_id").groupBy("cluster", "label").agg(F.count("*").alias("n"))


def cluster_labels(df: DataFrame, membership: DataFrame, label_col: str = "label", id_col: str = "row_id") -> DataFrame:
    """cluster, label: the commonest label, the smaller one on ties, neutral without any."""
    best = cluster_votes(df, membership, label_col, id_col).groupBy("cluster").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return membership.select("cluster").distinct().join(best, "cluster", "left").select("cluster", F.coalesce("label", F.lit(NEUTRAL)).alias("label"))


def nearest_neighbour(df: DataFrame, base: DataFrame, text_col: str = "text", id_col: str = "row_id", label_col: str = "label") -> DataFrame:
    return knn_neighbours(df, base, 1, "ascii", text_col, id_col, label_col).select("query_id", "base_id", "distance")


def fit_tree(base: DataFrame, method: str = "average", text_col: str = "text", id_col: str = "row_id", fit_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(fitted rows, merges): a tree of the whole base. Only where ``fit_rows`` is given, a base above so many rows is sampled for it, by a hash of the id."""
    fitted = base
    if fit_rows is not None and base.count() > fit_rows:
        fitted = base.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit("|fit"))), id_col).limit(fit_rows)
    fitted = stored(fitted, "fitted")
    return fitted, stored(linkage(fitted, method, text_col, id_col), "tree")


def classify_by_tree(df: DataFrame, base: DataFrame, tree: tuple[DataFrame, DataFrame], k: int = 3, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """The rows with ``estimated``, in place of a column of that name: the label of their nearest fitted row's cluster.

    Rows of the base outside the tree join their nearest fitted row's cluster, so all of the base votes on the clusters' labels.
    """
    fitted, merges = tree
    membership = stored(cut(merges, fitted, k, id_col), "membership")
    others = base.join(fitted.select(id_col), id_col, "left_anti")
    near = nearest_neighbour(others, fitted, text_col, id_col).join(membership.withColumnRenamed("row_id", "base_id"), "base_id")
    voters = stored(membership.unionByName(near.select(F.col("query_id").alias("row_id"), "cluster")), "voters")
    labels = cluster_labels(base, voters, id_col=id_col)
    asked = nearest_neighbour(df, fitted, text_col, id_col).join(membership.withColumnRenamed("row_id", "base_id"), "base_id").join(labels, "cluster")
    return df.drop("estimated").join(asked.select(F.col("query_id").alias(id_col), F.col("label").alias("estimated")), id_col, "left")


def classify_cluster(df: DataFrame, base: DataFrame, k: int = 3, method: str = "average", text_col: str = "text", id_col: str = "row_id", fit_rows: int | None = None) -> DataFrame:
    """The rows with ``estimated``, by a tree of the base (of at most ``fit_rows`` rows, if given) cut into k clusters."""
    return classify_by_tree(df, base, fit_tree(base, method, text_col, id_col, fit_rows), k, text_col, id_col)
