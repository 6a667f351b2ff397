"""Jobs: read, one operator, write. ``python -m labelwright.plans.jobs clean IN OUT``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from labelwright.operators import bayes, clean, profile, wordlist
from labelwright.operators.cluster import classify_cluster
from labelwright.operators.knn import classify_knn
from labelwright.plans.chains import METHODS, label_by_seed
from labelwright.sources.charset import detect_text
from labelwright.sources.files import read_labelled, read_raw_csv, read_words, write_labelled
from labelwright.tables import temporary


def run_clean(spark: SparkSession, source: str, target: str, header: bool = True, report: str | None = None) -> None:
    """Find the columns of a raw CSV, decode every cell, clean the messages, drop repeats, write ``rating,message``; and, from the same pass, what
    the rules did (counts, duplicates, audit) as tables under ``report``."""
    raw = read_raw_csv(spark, source, header, encoding="ISO-8859-1")
    names = [c for c in raw.columns if c != "row_id"]
    raw = raw.select("row_id", *[detect_text(F.col(f"`{c}`"))["text"].alias(c) for c in names])
    text, rating = profile.sniff_columns(raw.select(*names)).first()
    rows = raw.select("row_id", F.col(f"`{names[text]}`").alias("text"), *([F.regexp_replace(f"`{names[rating]}`", '"', "").alias("given")] if rating is not None else []))
    done = clean.clean_pass(rows, rating_col="given" if rating is not None else None, audit=report is not None)
    write_labelled(done.rows.select("rating", F.col("text").alias("message")), target)
    if report is not None:
        done.counts.write.parquet(f"{report}/counts")
        done.duplicates.write.parquet(f"{report}/duplicates")
        done.audit.write.parquet(f"{report}/audit")


def run_label(spark: SparkSession, method: str, base: str, source: str, target: str, words: tuple[str, str] | None = None) -> None:
    """Label the messages of one file by a labelled base (bayes, knn, cluster) or by word lists (words)."""
    rows = read_labelled(spark, source, escaped=True).drop("label")
    if method == "words":
        lists = read_words(spark, words[0], "pos").unionByName(read_words(spark, words[1], "neg"))
        done = wordlist.classify_wordlist(rows, lists)
    else:
        known = read_labelled(spark, base, escaped=True)
        done = bayes.classify_bayes(rows, bayes.train_bayes(known)) if method == "bayes" else classify_knn(rows, known) if method == "knn" else classify_cluster(rows, known)
    write_labelled(done.select(F.col("estimated").alias("rating"), F.col("text").alias("message")), target)


def run_chain(spark: SparkSession, method: str, source: str, target: str, words: tuple[str, str]) -> None:
    """Label a file without labels: word lists label what they know, and that is the base of the method for the rest."""
    lists = read_words(spark, words[0], "pos").unionByName(read_words(spark, words[1], "neg"))
    done = label_by_seed(read_labelled(spark, source, escaped=True).drop("label"), lists, method)
    write_labelled(done.select(F.col("estimated").alias("rating"), F.col("text").alias("message")), target)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    sub = parser.add_subparsers(dest="job", required=True)
    one = sub.add_parser("clean")
    one.add_argument("source")
    one.add_argument("target")
    one.add_argument("--no-header", action="store_true")
    one.add_argument("--report")
    two = sub.add_parser("label")
    two.add_argument("method", choices=("bayes", "knn", "cluster", "words"))
    two.add_argument("base")
    two.add_argument("source")
    two.add_argument("target")
    two.add_argument("--words", nargs=2)
    three = sub.add_parser("chain")
    three.add_argument("method", choices=METHODS)
    three.add_argument("source")
    three.add_argument("target")
    three.add_argument("--words", nargs=2, required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    with temporary(spark):
        if args.job == "clean":
            run_clean(spark, args.source, args.target, not args.no_header, args.report)
        elif args.job == "chain":
            run_chain(spark, args.method, args.source, args.target, args.words)
        else:
            run_label(spark, args.method, args.base, args.source, args.target, args.words)


if __name__ == "__main__":
    main()
