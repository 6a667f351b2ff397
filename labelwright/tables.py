"""Tables written once into the folder that driver and executors share, to end a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``.

    Where a local session (one machine) names none, a temporary folder is made and named; a cluster must name its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Lists of the paths made inside each ``temporary`` that is open.
_OPEN: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written to the shared folder inside are dropped at the end. For a job that has written its result elsewhere by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for own in _OPEN[-1:]:
        own.append(path)
    return path


def stored(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    This ends the lineage: what follows neither recomputes ``df`` nor depends on blocks that live on one executor only, and
    columns made by a non-deterministic layout (row ids) stay fixed.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *order: str | Column, rank: str = "rank", total: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``rank``, the row's place from 0 on in the given order, which must be a total one, and for ``total`` = (column, name) the running sum.

    No task sees all rows: they are sorted by ranges, numbered inside each, and raised by what the ranges before hold (a row a range).
    """
    made = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    value = F.col(total[0]) if total else F.lit(0)
    parts = made.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_sum"))
    placed = made.join(F.broadcast(before), "_part").withColumn(rank, F.col("_rows") + F.col("_at").bitwiseAND((1 << 33) - 1))
    if total:
        placed = placed.withColumn(total[1], F.col("_sum") + F.sum(total[0]).over(Window.partitionBy("_part").orderBy("_at")))
    return placed.drop("_at", "_part", "_rows", "_sum")
