"""Floors of the learnt models on rows that they didn't learn from."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from labelwright.llm import queries

SMALL, MIDDLE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no tables")
def test_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_language(spark, SMALL)
    seen = got.filter("held_out").join(docs.filter("lang IS NOT NULL"), "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right")).first()
    assert seen.n > 100 and seen.right >= 0.98 * seen.n
    assert got.count() == docs.count() and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


@pytest.mark.skipif(not Path(MIDDLE).exists(), reason="no tables")
def test_toxicity(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "toxic")
    got = queries.op3_toxicity(spark, MIDDLE).filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("called")).collect()
    of = {r.toxic: (r.n, r.called) for r in got}
    assert of[1][0] > 50 and of[1][1] >= 0.85 * of[1][0] and of[0][1] <= 0.02 * of[0][0]
