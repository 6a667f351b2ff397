"""Which column holds the message and which the rating: header names first, then the cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Header names by kind, the longest message, the sniffed rows.
TEXT_NAMES = ("tweet", "message", "content", "data", "tweet_content")
RATING_NAMES = ("rating", "polarity", "grade", "positivity")
MAX_LEN, ROWS, DEFAULT_TEXT = 280, 10, 1
RATING_CELL = r'^("[024]"|[024])\z'


def match_headers(columns: list[str]) -> tuple[int | None, int | None]:
    """Positions of the text and rating columns by name; the last match of a kind wins."""
    found: list[int | None] = [None, None]
    for i, name in enumerate(columns):
        for kind, names in enumerate((TEXT_NAMES, RATING_NAMES)):
            if name.lower() in names:
                found[kind] = i
    return found[0], found[1]


def _cells(df: DataFrame, n: int | None) -> DataFrame:
    """(pos, cell) of the first ``n`` rows or all; one scan for all columns."""
    rows = df if n is None else df.limit(n)
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    return rows.select(F.posexplode(cells).alias("pos", "cell"))


def profile_columns(df: DataFrame, n: int | None = ROWS) -> DataFrame:
    """pos, max_len, avg_len (whole part), n_rows, all_ratings of each column; lengths in UTF-8 bytes."""
    size = F.octet_length("cell")
    aggs: list[Column] = [F.max(size).cast("long").alias("max_len"), F.floor(F.sum(size) / F.count("*")).alias("avg_len"), F.count("*").alias("n_rows"), F.bool_and(F.col("cell").rlike(RATING_CELL)).alias("all_ratings")]
    return _cells(df, n).groupBy("pos").agg(*aggs)


def sniff_columns(df: DataFrame, n: int | None = ROWS, max_len: int = MAX_LEN, default_text: int = DEFAULT_TEXT, header: bool = True) -> DataFrame:
    """One row (data_column, rating_column): by header, else by cells.

    A text column has no cell longer than ``max_len``; the longest mean wins, the first on ties. The rating column is the first whose
    cells are all 0, 2 or 4, plain or quoted. With nothing found the text is column ``default_text`` and there is no rating.
    """
    text, rating = match_headers(df.columns) if header else (None, None)
    if text is not None and rating is not None:
        return df.sparkSession.createDataFrame([(text, rating)], "data_column int, rating_column int")
    p = profile_columns(df, n)
    score = F.when(F.col("max_len") <= max_len, F.struct((F.lit(max_len) - F.col("avg_len")).alias("score"), "pos"))
    found = p.agg(F.min(score)["pos"].alias("d"), F.min(F.when(F.col("all_ratings"), F.col("pos"))).alias("r"))
    return found.select(F.coalesce(F.lit(text), F.col("d"), F.lit(default_text)).cast("int").alias("data_column"), F.coalesce(F.lit(rating), F.col("r")).cast("int").alias("rating_column"))
