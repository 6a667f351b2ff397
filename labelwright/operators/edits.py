"""Manual labels: cell edits merged into rows, or into a stored table of which only the touched partitions are written again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.tables import stored

EDITS = "edit_seq long, row_id long, column string, value string"
#: Ids of one partition of a stored table. Ids in file order without gaps fill partitions evenly.
PART_ROWS = 1_000_000
PARTS = "part"
#: Touched partitions up to which they are listed in the scan's filter; more are joined.
LISTED = 10_000


def _fits(kinds: dict[str, str], columns: Sequence[str]) -> Column:
    """Whether an edit can be done: its column is one of ``columns`` and its value, if any, reads as that column's type."""
    able = F.lit(False)
    for c in columns:
        able = F.when(F.col("column") == c, F.col("value").isNull() | F.col("value").try_cast(kinds[c]).isNotNull()).otherwise(able)
    return F.coalesce(able, F.lit(False))


def _newest(edits: DataFrame, kinds: dict[str, str], columns: Sequence[str], id_col: str) -> DataFrame:
    """A row an id with a struct (value) for each edited column."""
    order = F.struct(F.col("edit_seq"), F.col("value").isNotNull(), F.col("value"))
    last = [F.max_by(F.struct("value"), F.when(F.col("column") == c, order)).alias(f"_new_{c}") for c in columns]
    return edits.filter(_fits(kinds, columns) & F.col(id_col).isNotNull()).groupBy(id_col).agg(*last)


def apply_label_edits(df: DataFrame, edits: DataFrame, columns: tuple[str, ...] = ("label", "text"), id_col: str = "row_id") -> DataFrame:
    """``edits`` (edit_seq, row_id, column, value): the last edit of a cell wins; of edits with one number, the greater value.

    A null value empties the cell. A value that doesn't read as the column's type, and an edit of another column, is no edit: the one before
    holds (``rejected_edits`` lists them). Rows without an id are dropped, edits of unknown rows have no effect.
    """
    kinds = dict(df.dtypes)
    joined = df.filter(F.col(id_col).isNotNull()).join(_newest(edits, kinds, columns, id_col), id_col, "left")
    cell = lambda c: F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.value").try_cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c)
    return joined.select(*[cell(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def rejected_edits(df: DataFrame, edits: DataFrame, columns: tuple[str, ...] = ("label", "text"), id_col: str = "row_id") -> DataFrame:
    """Edits that are no edits of ``df``'s columns: another column, a value of another type, or no id."""
    return edits.filter(~_fits(dict(df.dtypes), columns) | F.col(id_col).isNull())


def write_editable(df: DataFrame, path: str, id_col: str = "row_id", part_rows: int = PART_ROWS) -> None:
    """Store rows for ``edit_stored``: ``path``/rows holds them by ranges of ``part_rows`` ids, ``path``/size that number. Rows without an id are left out."""
    rows = df.filter(F.col(id_col).isNotNull()).withColumn(PARTS, F.floor(F.col(id_col) / part_rows).cast("long"))
    rows.repartition(PARTS).write.partitionBy(PARTS).parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(part_rows,)], "part_rows long").coalesce(1).write.parquet(f"{path}/size")


def read_editable(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop(PARTS)


def applied_up_to(spark: SparkSession, path: str) -> int | None:
    """The greatest edit_seq that the stored table has taken in; None before the first."""
    try:
        return spark.read.schema("edit_seq long").parquet(f"{path}/applied").agg(F.max("edit_seq")).first()[0]
    except Exception as e:  # no mark yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def edit_stored(spark: SparkSession, path: str, edits: DataFrame, columns: tuple[str, ...] = ("label", "text"), id_col: str = "row_id") -> int:
    """Take the edits numbered above the table's mark into the table at ``path``; returns how many partitions were written.

    Only partitions that hold an edited row are read and written; files of all others stay as they are. The mark is moved last, so a run that
    broke off is simply run again: the same edits give the same rows. A second run with the same edits writes nothing. Edits are as in
    ``apply_label_edits``; one that arrives later with a number at or below the mark is not taken.
    """
    mark, part_rows = applied_up_to(spark, path), spark.read.parquet(f"{path}/size").first()[0]
    new = stored(edits.filter(F.lit(True) if mark is None else F.col("edit_seq") > mark), "edits")
    last = new.agg(F.max("edit_seq")).first()[0]
    if last is None:
        return 0
    table = spark.read.parquet(f"{path}/rows")
    wanted = new.filter(_fits(dict(table.dtypes), columns) & F.col(id_col).isNotNull())
    parts = stored(wanted.select(F.floor(F.col(id_col) / part_rows).cast("long").alias(PARTS)).distinct(), "touched")
    few = [r[0] for r in parts.limit(LISTED + 1).collect()]
    touched = table.filter(F.col(PARTS).isin(few)) if len(few) <= LISTED else table.join(parts, PARTS, "left_semi")  # a list prunes the folders
    merged = stored(apply_label_edits(touched, wanted, columns, id_col).select(*table.columns), "edited")
    written = merged.select(PARTS).distinct().count()
    if written:
        merged.repartition(PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTS).parquet(f"{path}/rows")
    spark.createDataFrame([(last,)], "edit_seq long").coalesce(1).write.mode("append").parquet(f"{path}/applied")
    return written
