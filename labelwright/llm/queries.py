"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm import alignment, genetic, langid, media, minhash, mixing, packing, quotes, runs, substring, tokencodes, topk, toxicity
from labelwright.llm.common import cut, documents
from labelwright.llm.fitting import held_out


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = toxicity.score(docs.select("doc_id", "text"), model, "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(documents(spark, sf_dir)))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(media.store_texts(documents(spark, sf_dir)), "media")
    return media.read_media(stored).withColumn("feature", F.lower(F.hex("cosine_hash"))).drop("cosine_hash")


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = tokencodes.write_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokencodes.read_documents(shards)


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    threaded = quotes.thread(quotes.quoting(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return threaded.select("conv_id", "position", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", quotes.chat_line(F.col("role"), F.col("text")).alias("line"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(documents(spark, sf_dir))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.aligned_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.withColumnRenamed("groups", "groups_sha256")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genetic.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.with_period(documents(spark, sf_dir).select("doc_id", "text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_repeats": op4_repeats,
    "op5_pack": op5_pack,
    "op6_media": op6_media,
    "op7_token_codes": op7_token_codes,
    "op8_quotes": op8_quotes,
    "op9_mix": op9_mix,
    "op10_top_k": op10_top_k,
    "op11_alignment": op11_alignment,
    "op12_best_fit": op12_best_fit,
    "op13_runs": op13_runs,
}

ORACLE_SQL: dict[str, str] = {"op1_near_duplicates": minhash.ORACLE, "op4_repeats": substring.ORACLE, "op8_quotes": quotes.ORACLE, "op9_mix": mixing.ORACLE, "op10_top_k": topk.ORACLE, "op13_runs": runs.ORACLE}
