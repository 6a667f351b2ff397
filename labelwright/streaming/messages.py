"""The stateless part of the labelling jobs on a stream of messages: the same functions, since all of them are narrow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from labelwright.operators.clean import Rule, apply_rules, assign_rating, default_rules
from labelwright.operators.wordlist import classify_wordlist


def clean_stream(messages: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """row_id, rating, text of a stream of (row_id, text); keep-first duplicates need all messages and are left to the batch."""
    return apply_rules(assign_rating(messages), default_rules() if rules is None else rules).select("row_id", "rating", "text")


def label_stream(messages: DataFrame, words: DataFrame, path: str, checkpoint: str, weight: float = 0.5) -> StreamingQuery:
    """Labels each micro-batch by word lists and appends it to ``path``; a batch that is run again overwrites its own folder."""

    def label(batch: DataFrame, number: int) -> None:
        classify_wordlist(batch, words, weight).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return messages.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
