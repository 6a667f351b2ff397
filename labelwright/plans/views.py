"""Inputs of the registered queries: whole tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIVE_WORDS = "in and to is la der".split()
NEGATIVE_WORDS = "the of a en die que".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, text, label of every labelled document: toxic 0, else good quality 4, else 2."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 4).otherwise(2).alias("label"))
    return docs.join(labels, "row_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what messages carry (retweets, addresses, users, emoticons), by its id, since the texts have none."""
    kind, text = F.col("row_id") % 7, F.col("text")
    return messages(spark, sf_dir).withColumn("text", F.when(kind == 0, F.concat(F.lit("RT "), text)).when(kind == 1, F.concat(text, F.lit(" http://t.co/x"))).when(kind == 2, F.concat(F.lit("hello @user12 "), text)).when(kind == 3, F.concat(F.lit(":) "), text, F.lit(" :("))).when(kind == 4, F.concat(F.lit(":( is not :D "), text)).otherwise(text))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), "text", (F.col("item_id") % 3 * 2).cast("int").alias("label"))


def words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, "pos") for w in POSITIVE_WORDS] + [(w, "neg") for w in NEGATIVE_WORDS], "word string, polarity string")
