"""Lines of files in byte ranges, and rows numbered in file order.

Spark splits a text file into byte ranges and reads whole lines of each. What a range needs to know of those before it (how many
rows they have, whether a quoted cell is still open) is one small row a range, combined by windows over the ranges of a file. The numbers
that follow are the same for any split size and any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from labelwright.tables import stored

#: Ranges whose table (three numbers each) is broadcast; with more of them, rows are dealt by range and sorted there.
BROADCAST_RANGES = 1_000_000


def ranged(rows: DataFrame) -> DataFrame:
    """The rows of a scan with ``_file``, ``_start`` (their byte range) and ``_place`` (their order in it)."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_place"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value (the bytes of a line without its line feed), _file, _start, _place."""
    return ranged(spark.read.text(path, lineSep="\n")).withColumn("value", F.col("value").cast("binary"))


def told(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row with what ``ranges`` (a row for each _file and _start) says of its range, rows of a range together and in order.

    A range that the table doesn't know, since files changed or were split otherwise in between, fails the job.
    """
    named = ranges.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), *[c for c in ranges.columns if c not in ("_file", "_start")])
    on = (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s"))
    if ranges.count() <= BROADCAST_RANGES:
        joined = rows.join(F.broadcast(named), on, "left")
    else:
        joined = rows.join(named, on, "left").repartition("_range").sortWithinPartitions("_range", "_place")
    known = F.when(F.col("_range").isNull(), F.raise_error(F.lit("the files were split otherwise when they were read again"))).otherwise(F.col("_range"))
    return joined.withColumn("_range", known).drop("_f", "_s")


def numbered(rows: DataFrame, name: str = "row_id") -> DataFrame:
    """``ranged`` rows with a number from 0 on in file order (path, then place in the file) instead of their range: no gaps.

    Two passes: rows of each range are counted, then numbered from the sum of those before. What is broadcast has a row a range.
    """
    counts = rows.groupBy("_file", "_start").agg(F.count("*").alias("n"))
    in_file = Window.partitionBy("_file").orderBy("_start")
    files = counts.groupBy("_file").agg(F.sum("n").alias("all"))  # a row a file
    before = files.select("_file", (F.sum("all").over(Window.orderBy("_file")) - F.col("all")).alias("before"))
    first = counts.join(before, "_file").select("_file", "_start", (F.col("before") + F.sum("n").over(in_file) - F.col("n")).alias("_first"))
    ranges = stored(first.withColumn("_range", F.monotonically_increasing_id()), "ranges")
    kept = [c for c in rows.columns if c not in ("_file", "_start", "_place")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = done = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            own, first = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            place, last, done = places(own, last, done)
            yield pa.RecordBatch.from_arrays([pa.array(first + place), *batch.columns[:-2]], names=[name, *kept])

    schema = StructType([StructField(name, LongType()), *[rows.schema[c] for c in kept]])
    return told(rows, ranges).select(*[F.col(f"`{c}`") for c in kept], "_range", "_first").mapInArrow(number, schema)


def places(own: np.ndarray, last: int, done: int) -> tuple[np.ndarray, int, int]:
    """The place of each row in its range, given the last row's range and place of the batch before; and the same for the next."""
    new = np.append(own[0] != last, own[1:] != own[:-1])
    at = np.arange(own.size)
    begin = np.maximum.accumulate(np.where(new, at, 0))
    place = at - begin
    if not new[0]:
        first = int(np.argmax(new)) if new.any() else own.size
        place[:first] += done + 1
    return place, int(own[-1]), int(place[-1])
