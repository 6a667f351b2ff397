"""Readers and writers of labelled messages, raw tables and word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.sources.ranges import numbered, ranged
from labelwright.sources.records import WIDE, read_records


def _lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """One column ``line``; splittable, and the first line of each file is left out if ``header``."""
    return spark.read.schema("line string").option("header", header).option("sep", "\u0001").option("quote", "").option("lineSep", "\n").option("enforceSchema", True).csv(path)


def read_labelled(spark: SparkSession, path: str, escaped: bool = False) -> DataFrame:
    """row_id, label, text from lines ``label,text``, without the first line of each file.

    Lines whose first field isn't a plain integer, or that have no comma, are dropped. The rest of the line, without a carriage return at its
    end, is the text, without the quotes at its ends; quotes inside stay as they are, doubled or not. With ``escaped`` the lines are those
    of ``write_labelled``: a text in quotes loses one at each end and doubled ones inside become single. ``row_id`` counts the rows from 0 in
    file order, without gaps, however files are split.
    """
    rows = ranged(_lines(spark, path, True)).filter(F.col("line").contains(","))
    first = F.substring_index("line", ",", 1)
    rest = F.regexp_replace(F.substring(F.col("line"), F.length(first) + 2, F.length("line")), r"\r\z", "")
    text = F.regexp_replace(rest, r'^"+|"+\z', "")
    if escaped:
        text = F.when(rest.rlike(r'^".*"\z'), F.replace(F.substring(rest, F.lit(2), F.length(rest) - 2), F.lit('""'), F.lit('"'))).otherwise(rest)
    rows = rows.select(F.when(first.rlike(r"^[+-]?[0-9]+\z"), first.try_cast("int")).alias("label"), text.alias("text"), "_file", "_start", "_place")
    return numbered(rows.filter("label IS NOT NULL"))


def read_raw_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text with ``row_id`` (from 0 in file order, without gaps); a record of another length fails the job. Empty cells are ''.

    Records may span lines and yet a file is read by many tasks. In encodings whose quotes and line feeds can't be told by byte a
    file is one task's, and row_id has gaps.
    """
    names = _whole_csv(spark, path, header, sep, encoding).columns
    if not WIDE.search(encoding):
        return read_records(spark, path, names, header, sep, encoding)
    rows = _whole_csv(spark, path, header, sep, encoding)
    return rows.select(F.monotonically_increasing_id().alias("row_id"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names])


def _whole_csv(spark: SparkSession, path: str, header: bool, sep: str, encoding: str) -> DataFrame:
    """Each file by one task."""
    reader = spark.read.option("header", header).option("multiLine", True).option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("encoding", encoding).option("inferSchema", False)
    return reader.csv(path)


def _windows() -> tuple[str, str]:
    """The characters that ISO-8859-1 and windows-1252 read differently, by the codec; five bytes have none and stay."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs)


def decode_text(column: Column) -> Column:
    """struct(text, encoding) of text read as ISO-8859-1: its bytes as UTF-8 where they are valid, else as windows-1252 if some
    are control characters otherwise, else as they were read."""
    data = F.encode(column, "ISO-8859-1")
    valid = F.is_valid_utf8(data.cast("string"))
    as_read = F.struct(column.alias("text"), F.lit("ISO-8859-1").alias("encoding"))
    windows = F.struct(F.translate(column, *_windows()).alias("text"), F.lit("windows-1252").alias("encoding"))
    return F.when(valid, F.struct(F.decode(data, "UTF-8").alias("text"), F.lit("UTF-8").alias("encoding"))).when(column.rlike(r"[\x80-\x9F]"), windows).otherwise(as_read)


def read_words(spark: SparkSession, path: str, polarity: str) -> DataFrame:
    """word, polarity from a word a line: trimmed, lower-cased, empty ones and repeats left out."""
    return spark.read.text(path).select(F.lower(F.regexp_replace("value", r"^\s+|\s+\z", "")).alias("word")).filter("word <> ''").distinct().withColumn("polarity", F.lit(polarity))


def read_words_csv(spark: SparkSession, path: str, polarity: str) -> DataFrame:
    """word, polarity from comma-separated words: trimmed, case and repeats kept."""
    words = spark.read.text(path).select(F.explode(F.split("value", ",", -1)).alias("word"))
    return words.select(F.regexp_replace("word", r"^\s+|\s+\z", "").alias("word"), F.lit(polarity).alias("polarity")).filter("word <> ''")


def write_labelled(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """``rating,message`` with a header (a reader that skips the first line then loses no row), quotes only where needed."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        writer.format(fmt).save(path)
