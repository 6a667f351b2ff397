"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight; small keys win. A source's target is met by whole
epochs first and then by the documents of smallest key, up to the budget. Prefix sums run in two levels: keys are cut into bins of
equal ratio, that are summed per source, so only the one bin in which a source's budget ends is sorted. Whatever a source's weights are,
they scale its keys, which only moves them along such bins: no bin has much more than a thousandth of a large source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwright.llm.common import cut, word_count

#: Bins of keys from one to its double.
BINS = 1024
#: Sources up to which the table of thresholds (one row a source) is broadcast; beyond it, it is joined.
BROADCAST_SOURCES = 100_000
MAX_EPOCHS = 3
CYCLE = 3
#: Characters that seldom stand in prose.
CLUTTER = "0123456789|{}[]<>=_/@#$%&*~+"


def quality_weight(text: Column) -> Column:
    """1 for text without clutter, falling with the share of digits, bars and symbols."""
    size = F.char_length(F.coalesce(text, F.lit("")))
    clean = F.char_length(F.translate(F.coalesce(text, F.lit("")), CLUTTER, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * (size - clean) / F.greatest(size, F.lit(1)))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: str = "mix") -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash of the id and the text: the same in every run, for rows that share an id
    or have none too."""
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    bits = F.conv(F.substring(F.md5(named), 1, 13), 16, 10)
    return -F.ln((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def keyed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds ``_size`` (words), ``_key`` and ``_bin``; every document of one bin has a smaller key than any of the next."""
    docs = docs.withColumns({"_size": word_count(F.col("text")), "_key": sampling_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text")), seed)})
    return docs.withColumn("_bin", F.floor(F.lit(BINS) * F.log2("_key")).cast("int"))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, cycle: int = CYCLE) -> DataFrame:
    """Target words of each source from (source, source_size).

    Sources in code point order, null last, weigh 1, 2, .. ``cycle``, repeating, and share all words. A target stops at
    ``max_epochs`` times its source; the excess is shared again by weight. In closed form: with sources ordered by cap /
    weight, one level x makes every target min(cap, x * weight), and x is the first that its own source still bears.
    The input has one row a source, so its global windows sort a table of source names only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before, up_to = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(up_to)
    ranked = named.withColumns({"level": level, "place": F.row_number().over(by_cap)})
    ranked = ranked.withColumn("bears", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level")))
    ranked = ranked.withColumn("share", F.min("bears").over(whole)["level"])
    return ranked.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("share") * F.col("weight")).alias("target"))


def thresholds(slim: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: source_size, target, epochs, ``last``, the (key, size, doc_id) of the last document of the fraction, and how
    many rows (``few`` of ``alike``) like that one are in it.

    A document is in the fraction if the middle of its words lies before the budget's end, so a source misses its
    target by at most half a document. Rows alike are counted before anything is sorted, so copies make no large sort.
    """
    per_bin = slim.groupBy("source", "_bin").agg(F.sum("_size").alias("words"))
    targets = source_targets(per_bin.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = cut(targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    running = Window.partitionBy("source").orderBy("_bin")
    bins = per_bin.withColumn("through", F.sum("words").over(running)).withColumn("before", F.col("through") - F.col("words"))
    t = targets.withColumnRenamed("source", "of")
    ends = bins.join(t, F.col("source").eqNullSafe(F.col("of"))).filter("through > budget").groupBy("source").agg(F.min_by(F.struct("_bin", "before", "budget"), "_bin").alias("end"))
    ends = ends.select(F.col("source").alias("of"), F.col("end._bin").alias("end_bin"), F.col("end.before").alias("before"), F.col("end.budget").alias("budget"))
    edge = slim.join(F.broadcast(ends) if ends.count() <= BROADCAST_SOURCES else ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("_bin") == F.col("end_bin")))
    edge = edge.groupBy("source", "_key", "_size", "doc_id", "end_bin", "before", "budget").agg(F.count("*").alias("alike"))
    in_bin = Window.partitionBy("source").orderBy("_key", "_size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("_size") * F.col("alike")).over(in_bin), F.lit(0))
    # The j-th of rows alike is in if start + (j - 1/2) * size < budget; rows without words cost nothing.
    few = F.when(F.col("_size") > 0, F.ceil((F.col("budget") - F.col("start")) / F.col("_size") - F.lit(0.5))).when(F.col("start") < F.col("budget"), F.col("alike")).otherwise(0)
    edge = edge.withColumn("start", start).withColumn("few", F.least("alike", few))
    last = edge.groupBy("source").agg(F.max("end_bin").alias("end_bin"), F.max(F.when(F.col("few") > 0, F.struct(F.struct("_key", "_size", "doc_id").alias("last"), "few", "alike"))).alias("l"))
    last = last.select("source", "end_bin", "l.*")
    return targets.join(last.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "budget")


def decide(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds source_size, target, copies and taken to rows with source, doc_id, ``_size``, ``_key``, ``_bin``. Narrow if sources are few."""
    limits = cut(limits, "thresholds")
    few = limits.count() <= BROADCAST_SOURCES
    limits = limits.withColumnRenamed("source", "_of")
    joined = rows.join(F.broadcast(limits) if few else limits, F.col("source").eqNullSafe(F.col("_of")))
    rank, on_edge = F.struct("_key", "_size", "doc_id"), F.col("_bin") == F.col("end_bin")
    joined = joined.withColumn("_tied", F.coalesce(on_edge & rank.eqNullSafe(F.col("last")) & (F.col("few") < F.col("alike")), F.lit(False)))
    within = (F.col("_bin") < F.col("end_bin")) | (on_edge & (rank <= F.col("last")))
    decided = joined.withColumn("_in", F.coalesce(within, F.lit(False)))
    if not limits.filter("few < alike").isEmpty():
        decided = decided.filter("NOT _tied").unionByName(_numbered(joined.filter("_tied")).withColumn("_in", F.col("_nth") <= F.col("few")).drop("_nth"))
    decided = decided.withColumn("copies", F.col("epochs") + F.col("_in").cast("long"))
    return decided.withColumn("taken", F.col("copies") * F.col("_size")).drop("_of", "end_bin", "last", "epochs", "weight", "few", "alike", "_tied", "_in")


def _numbered(rows: DataFrame) -> DataFrame:
    """``_nth``, from 1, of rows alike of a source: counted in each part, and over the parts before; no part gathers a source."""
    rows = cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "tied")
    counts = rows.groupBy("source", "_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("source").alias("_source"), F.col("_part").alias("_at"), (F.sum("_n").over(Window.partitionBy("source").orderBy("_part")) - F.col("_n")).alias("_before"))
    own = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("source", "_part").orderBy("_row")))
    joined = own.join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn("_nth", F.col("_nth") + F.col("_before")).drop("_source", "_at", "_before", "_part", "_row")


def mixing_plan(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken.

    A null text has no words; it is taken 0 words whatever its copies. A null source is a source of its own, last in order.
    An empty table gives no rows. Rows that repeat a doc_id, or have none, draw by their texts; of rows alike in both as many are
    taken as the budget holds. Texts of any length are one word count; other columns are left out.
    """
    slim = cut(keyed(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")), seed).drop("text"), "mix-keys")
    return decide(slim, thresholds(slim)).select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each document as many times as the plan copies it, with the columns it had.

    Columns of the documents may have any names; those that this operator uses inside are kept apart.
    """
    names = docs.columns
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc")).select("_doc", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.source").cast("string").alias("source"), F.col("_doc.text").cast("string").alias("text"))
    wide = keyed(base, seed)
    slim = cut(wide.select("doc_id", "source", "_size", "_key", "_bin"), "mix-keys")
    taken = decide(wide.drop("text"), thresholds(slim)).filter("copies > 0")
    copies = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select("_doc.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || t), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
         / (1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(t) - length(translate(t, '0123456789|{}[]<>=_/@#$%&*~+', ''))) / greatest(length(t), 1))) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS place,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), x AS (
  SELECT arg_min(level, place) AS share FROM l WHERE level <= cap::DOUBLE / weight
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, share * weight) AS target FROM l, x
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.source, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size / 2.0::DOUBLE AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, source, size, source_size, target,
       epochs + CASE WHEN middle < budget AND size > 0 THEN 1 ELSE 0 END AS copies,
       CAST(epochs + CASE WHEN middle < budget THEN 1 ELSE 0 END AS BIGINT) * size AS taken
FROM r
"""
