"""Train, label and compare in one go: the evaluation of each method on a stratified third."""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelwright.operators.bayes import SMOOTHING, bayes_model, classify_bayes, count_bayes, train_bayes
from labelwright.operators.cluster import FIT_ROWS, METHODS, classify_by_tree, classify_cluster, fit_tree
from labelwright.operators.evaluate import RATIO, stratified_split
from labelwright.operators.knn import classify_knn, knn_neighbours, vote
from labelwright.operators.wordlist import classify_wordlist
from labelwright.tables import stored


def split(df: DataFrame, seed: int = 0, ratio: float = RATIO) -> tuple[DataFrame, DataFrame]:
    """(train, test), written once, so that all that follows shares one split."""
    rows = stored(stratified_split(df, ratio, seed), "split")
    return rows.filter("is_train").drop("is_train"), rows.filter("NOT is_train").drop("is_train")


def _pairs(labelled: DataFrame) -> DataFrame:
    return labelled.filter("estimated IS NOT NULL").selectExpr("row_id", "label AS real", "estimated")


def evaluate_wordlist(df: DataFrame, words: DataFrame, weight: float = 0.5, seed: int = 0) -> DataFrame:
    return _pairs(classify_wordlist(split(df, seed)[1], words, weight))


def evaluate_knn(df: DataFrame, k: int = 5, kind: str = "majority", seed: int = 0) -> DataFrame:
    train, test = split(df, seed)
    return _pairs(classify_knn(test, train, k, kind))


def evaluate_bayes(df: DataFrame, alpha: float | str = 1.0, repr: str = "frequency", ngram: str = "unibi", seed: int = 0) -> DataFrame:
    train, test = split(df, seed)
    return _pairs(classify_bayes(test, train_bayes(train, alpha, repr, ngram)))


def evaluate_cluster(df: DataFrame, k: int = 3, method: str = "average", seed: int = 0, fit_rows: int | None = None) -> DataFrame:
    train, test = split(df, seed)
    return _pairs(classify_cluster(test, train, k, method, fit_rows=fit_rows))


def grid(df: DataFrame, words: DataFrame, ks: tuple[int, ...] = (3, 5, 10), seed: int = 0) -> dict[str, DataFrame]:
    """(real, estimated) of the word lists, of neighbours by k and vote, and of Bayes by representation and smoothing, on one split.

    Neighbours are searched once, for the largest k.
    """
    train, test = split(df, seed)
    made = {"words": _pairs(classify_wordlist(test, words))}
    near = stored(knn_neighbours(test, train, max(ks)), "neighbours")
    for k in ks:
        for kind in ("majority", "weighted"):
            found = vote(near.filter(near.rank <= k), kind).withColumnRenamed("query_id", "row_id")
            made[f"knn {k} {kind}"] = _pairs(test.join(found, "row_id"))
    for repr in ("frequency", "presence"):
        counts = count_bayes(train, repr)  # both smoothings are made of them
        for smoothing in SMOOTHING:
            made[f"bayes {repr} {smoothing}"] = _pairs(classify_bayes(test, bayes_model(counts, smoothing)))
    return made


def cluster_grid(df: DataFrame, ks: tuple[int, ...] = (2, 3), seed: int = 0, fit_rows: int = FIT_ROWS) -> dict[str, DataFrame]:
    """(real, estimated) of clusters by linkage and number, on one split."""
    train, test = split(df, seed)
    trees = {m: fit_tree(train, m, fit_rows=fit_rows) for m in METHODS}
    return {f"cluster {m} {k}": _pairs(classify_by_tree(test, train, tree, k)) for m, tree in trees.items() for k in ks}
