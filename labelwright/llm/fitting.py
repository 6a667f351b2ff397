"""Bounded samples for classifiers: which rows may be learnt from, and a fixed number of them for each label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out: crc32 of its id as text is divisible by ``FOLDS``. A null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


#: Bounds of a sample besides its rows: labels learnt at most, the commonest ones, as a column of free text may hold any number of
#: them; characters of a text; and of all texts together, which the driver holds.
MOST_LABELS, LONGEST, WHOLE = 512, 200_000, 150_000_000


def sample(rows: DataFrame, label: str, per_label: int, most_labels: int = MOST_LABELS) -> list[tuple]:
    """About ``per_label`` (doc_id, label) of each of the ``most_labels`` commonest labels, by a hash of doc_id, so the same rows every time.

    ``rows`` has doc_id and ``label``, without null. What reaches the driver is bounded by most_labels * per_label, twice that at most.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), label).limit(most_labels).collect()
    if not counts:
        return []
    shares = rows.sparkSession.createDataFrame([(r[0], min(1.0, per_label / r[1])) for r in counts], f"{label} {dict(rows.dtypes)[label]}, _share double")
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.join(F.broadcast(shares), label).filter(draw < F.col("_share"))
    return [tuple(r) for r in chosen.select("doc_id", label).limit(2 * per_label * len(counts)).collect()]


def texts_of(docs: DataFrame, chosen: list[tuple], label: str, kind: str, longest: int = LONGEST) -> list[tuple[str, object]]:
    """(text, label) of the chosen rows, in id order, one a doc_id; the chosen ids are broadcast, as few as ``sample`` takes.

    A text above ``longest`` characters, or above an equal share of ``WHOLE``, gives a stretch of so many, from a place that its id says; of rows
    that share an id one text is taken. So what is collected is bounded.
    """
    longest = max(1, min(longest, WHOLE // max(1, len(chosen))))
    ids = docs.sparkSession.createDataFrame(chosen, f"doc_id long, {label} {kind}").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.char_length("text") - longest, F.lit(0)) + 1) + 1
    texts = texts.withColumn("text", F.when(F.char_length("text") > longest, F.substring(F.col("text"), start.cast("int"), F.lit(longest))).otherwise(F.col("text")))
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text")).select("doc_id", "text", label).collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1]))]
