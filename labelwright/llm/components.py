"""Connected components of a table of links, by least labels and pointer jumping. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, root): for each linked id the smallest id that it reaches. Ids without a link are left out.

    Each round every id takes the least label among its neighbours' and then its label's label; rounds end when nothing
    changes. A round is written to the shared folder, so lost executors cost that round at most.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b"), "links")
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("id"), "root"), "labels")
    while True:
        seen = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("root").alias("seen"))
        own = labels.join(seen, labels.id == seen.a).select("id", F.col("root").alias("was"), F.least("root", "seen").alias("now"))
        jump = labels.select(F.col("id").alias("now"), F.col("root").alias("further"))
        moved = own.join(jump, "now", "left").select("id", "was", F.least("now", F.coalesce("further", "now")).alias("root"))
        moved = cut(moved, "labels")
        labels = moved.select("id", "root")
        if moved.filter("was <> root").isEmpty():
            return labels
