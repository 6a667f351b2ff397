"""Stratified split and confusion matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = (0, 2, 4)
RATIO = 2 / 3


def stratified_split(df: DataFrame, ratio: float = RATIO, seed: int = 0, label_col: str = "label", id_col: str = "row_id") -> DataFrame:
    """Adds ``is_train``: of each label exactly floor(n * ratio) rows, by a seeded hash of the id.

    The hash's first three digits make 4,096 bins a label. Bins are counted, only the bin in which the train part ends is
    sorted, all others are decided by comparison: a label with most of the rows is no single sort.
    """
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    rows = df.withColumn("_h", h).withColumn("_bin", F.substring("_h", 1, 3))
    bins = rows.groupBy(F.col(label_col).alias("_label"), "_bin").agg(F.count("*").alias("n"))
    running, whole = Window.partitionBy("_label").orderBy("_bin"), Window.partitionBy("_label")
    bins = bins.withColumns({"through": F.sum("n").over(running), "want": F.floor(F.sum("n").over(whole) * F.lit(float(ratio)))})
    edge = bins.filter("through > want").groupBy("_label").agg(F.min_by(F.struct("_bin", F.col("want").alias("want"), (F.col("through") - F.col("n")).alias("before")), "_bin").alias("e"))
    edge = edge.select("_label", F.col("e._bin").alias("_edge"), (F.col("e.want") - F.col("e.before")).alias("_take"))
    joined = rows.join(edge, F.col(label_col).eqNullSafe(F.col("_label")), "left")
    inside = F.coalesce(F.col("_bin") == F.col("_edge"), F.lit(False))
    clear = joined.filter(~inside).withColumn("is_train", F.coalesce(F.col("_bin") < F.col("_edge"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy(label_col).orderBy("_h", id_col))
    close = joined.filter(inside).withColumn("is_train", rank <= F.col("_take"))
    return clear.unionByName(close).select(*df.columns, "is_train")


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """real, estimated, n of (real, estimated) pairs: all nine cells, other pairs left out."""
    counts = pred.filter(F.col("real").isin(*CELLS) & F.col("estimated").isin(*CELLS)).groupBy("real", "estimated").agg(F.count("*").alias("n"))
    grid = pred.sparkSession.createDataFrame([(a, b) for a in CELLS for b in CELLS], "real int, estimated int")
    return grid.join(counts, ["real", "estimated"], "left").select("real", "estimated", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_totals(pred: DataFrame) -> DataFrame:
    """The matrix with its margins: a null real or estimated is a total over it."""
    return confusion_matrix(pred).cube("real", "estimated").agg(F.sum("n").alias("n"))


def accuracy(pred: DataFrame) -> DataFrame:
    return confusion_matrix(pred).agg((F.sum(F.when(F.col("real") == F.col("estimated"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


def compare_settings(settings: dict[str, DataFrame]) -> DataFrame:
    """setting, accuracy, n for predictions of several settings."""
    out = None
    for name, pred in settings.items():
        row = accuracy(pred).select(F.lit(name).alias("setting"), "accuracy", "n")
        out = row if out is None else out.unionByName(row)
    return out
