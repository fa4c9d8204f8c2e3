"""Streams of facts: each triple once, and question rows written by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import questions


def first_seen(facts: DataFrame, time_col: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows of a stream (root, s, p, o) whose triple was not seen before; with a time column the state is dropped after
    the watermark, without one it holds every triple."""
    keyed = facts.withColumn("key", names.triple_key(F.col("s"), F.col("p"), F.col("o")))
    if time_col:
        return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["key"])
    return keyed.dropDuplicates(["key"])


def write_questions(facts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that turns new facts into yes/no questions and hands each micro-batch to the sink once."""
    return first_seen(facts).writeStream.foreachBatch(lambda df, epoch: sink(questions.ask_rows(df), epoch)).option("checkpointLocation", checkpoint).start()
