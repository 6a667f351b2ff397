"""Chains of labellers: what one method is sure of is what the next one learns from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.operators.bayes import classify_bayes, train_bayes
from labelwright.operators.cluster import classify_cluster
from labelwright.operators.knn import classify_knn
from labelwright.operators.wordlist import classify_wordlist
from labelwright.tables import stored

METHODS = ("knn", "bayes", "cluster")


def label_by_seed(df: DataFrame, words: DataFrame, method: str = "knn", weight: float = 0.5, least: int = 1, k: int = 5, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """The rows with ``estimated`` and ``by``: word lists label the messages that have ``least`` of their words (by ``words``), and those are the
    base by which ``method`` labels the others.

    Without such a message nothing is known, and ``estimated`` is null. Columns named estimated, by, pos or neg are replaced.
    """
    if method not in METHODS:
        raise ValueError(f"{method}: {', '.join(METHODS)}")
    columns = [c for c in df.columns if c not in ("estimated", "by", "pos", "neg")]
    seeded = stored(classify_wordlist(df.select(*[F.col(f"`{c}`") for c in columns]), words, weight, text_col, id_col), "seeded")
    sure = F.col("pos") + F.col("neg") >= least
    known = seeded.filter(sure).select(*[F.col(f"`{c}`") for c in columns], "estimated", F.lit("words").alias("by"))
    base = known.select(F.col(id_col), F.col(text_col), F.col("estimated").alias("label"))
    asked = seeded.filter(~sure).select(*[F.col(f"`{c}`") for c in columns])
    if base.isEmpty():
        done = asked.withColumn("estimated", F.lit(None).cast("int"))
    elif method == "bayes":
        done = classify_bayes(asked, train_bayes(base, text_col=text_col), text_col, id_col)
    else:
        done = classify_knn(asked, base, k, text_col=text_col, id_col=id_col) if method == "knn" else classify_cluster(asked, base, text_col=text_col, id_col=id_col)
    return known.unionByName(done.withColumn("by", F.lit(method)).select(known.columns))
