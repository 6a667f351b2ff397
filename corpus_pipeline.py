"""From raw documents to packed sequences: five stages, each a training-data operator whose decisions take effect."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwright.llm import langid, minhash, mixing, packing, substring
from labelwright.llm.common import cut, documents

#: A text whose best language has less than this mean probability over its words is in none of the languages learnt.
LEAST_SCORE = 0.4
#: Files up to which the table of their numbers is broadcast (about 200 bytes each).
BROADCAST_FILES = 100_000


def _whole(docs: DataFrame) -> Column:
    """Each row as one struct ``_doc``, so a document's own columns may have any names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or in no known language go.

    Null and empty texts have no letters. Rows that repeat an id or have none are decided one by one; without a known ``lang`` there is
    nothing to learn, and all go. Very long texts are labelled whole.
    """
    rows = langid.identify(docs.select(_whole(docs), "text"), langid.train(docs), "_language")
    return rows.filter((F.col("_language.lang_pred") != "und") & (F.col("_language.score") >= LEAST_SCORE)).select("_doc.*")


def _named(docs: DataFrame) -> DataFrame:
    """(_doc, _row): each row with a number of its own that stays the same in every scan.

    Rows of Parquet files are numbered by their file and their place in it, so nothing is copied; any other table is written first.
    """
    try:
        placed = docs.select(_whole(docs), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:
        return cut(docs.select(_whole(docs), F.monotonically_increasing_id().alias("_row")), "rows")
    paths = placed.select("_path").distinct()
    files = cut(paths.select("_path", F.row_number().over(Window.orderBy("_path")).cast("long").alias("_file")), "files")  # a row a file
    joined = placed.join(F.broadcast(files) if files.count() <= BROADCAST_FILES else files, "_path")
    return joined.select("_doc", (F.shiftleft("_file", 40) + F.col("_index")).alias("_row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, rows without one last, any of rows alike.

    Rows have numbers of their own, so rows that repeat a doc_id or have none are decided one by one. Texts without words are in
    no group and stay.
    """
    named = _named(docs)
    found = minhash.near_duplicates(named.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")), percent=80)
    groups = found.select(F.col("doc_id").alias("_row"), "component_id").join(named.select("_row", F.col("_doc.doc_id").alias("doc_id")), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")).alias("first")
    kept = groups.groupBy("component_id").agg(first).select(F.col("first._row").alias("_row"))
    return named.join(kept, "_row", "left_semi").select("_doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a document that loses its last word goes. n_chars follows the text.

    Texts that lose nothing, null and empty ones among them, stay as they are.
    """
    rows = substring.remove_repeats(docs, spacing=True).filter("n_removed = 0 OR n_removed < n_words")
    given = F.col("row").getField
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(given("n_chars"))
    return rows.select(*[(new[c] if c in new else given(c)).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, from not at all to three times. A null source is one of its own."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of powers of two, at most 1,024 ids, with their ids. Null and empty texts are the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packed", packed)]

#: A learnt field of features and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
