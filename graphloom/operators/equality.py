"""Which names are one: connected components of (g, a, b) pairs, by contraction in DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import discard, saved


def _tidy(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _follow(table: DataFrame, column: str, label: DataFrame, name: str) -> DataFrame:
    """table with `column` replaced by its label where it has one. A label table has a row a node, so a node that most rows
    share is one hot key beside a single row, which adaptive execution splits."""
    look = label.select(F.col("g").alias("_g"), F.col("node").alias("_node"), F.col("rep").alias("_rep"))
    joined = table.join(look, (F.col("g") == F.col("_g")) & (F.col(column) == F.col("_node")), "left")
    return joined.withColumn(name, F.coalesce("_rep", F.col(column))).drop("_g", "_node", "_rep")


def representatives(pairs: DataFrame) -> DataFrame:
    """(g, node, rep) of every node of a pair: rep is the least name, in its graph, that pairs lead to.

    Each round every node takes the least label beside it, labels are followed once more, pairs are rewritten between labels
    and those within one vanish, until none is left. Labels are ordered by hash, so each round leaves a fraction of the nodes
    whatever the names; the least name of a component is found at the end. Null ends and loops give no pairs, and names without
    any are absent; graphs don't mix.
    """
    hashed = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), c).alias(c)
    live = saved(_tidy(pairs.where("a IS NOT NULL AND b IS NOT NULL").select("g", hashed("a"), hashed("b"))), "same-pairs")
    labels = live.select("g", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("rep", F.col("node"))
    while not live.isEmpty():
        both = live.unionByName(live.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("g", "a").agg(F.min("b").alias("m")).select("g", F.col("a").alias("node"), F.least("a", "m").alias("rep"))
        least = saved(least, "same-least")
        step = _follow(least.withColumnRenamed("rep", "r"), "r", least, "rep").select("g", "node", "rep")
        new_labels = saved(_follow(labels.withColumnRenamed("rep", "r"), "r", step, "rep").select("g", "node", "rep"), "same-labels")
        moved = _follow(_follow(live, "a", step, "a2"), "b", step, "b2").select("g", F.col("a2").alias("a"), F.col("b2").alias("b"))
        new_live = saved(_tidy(moved), "same-pairs")
        discard(labels, live, least)
        labels, live = new_labels, new_live
    plain = labels.select("g", F.expr("substring(node, 17)").alias("node"), "rep")
    names = plain.groupBy("g", "rep").agg(F.min("node").alias("name")).select(F.col("g").alias("_g"), F.col("rep").alias("_rep"), "name")
    return plain.join(names, (F.col("g") == F.col("_g")) & (F.col("rep") == F.col("_rep"))).select("g", "node", F.col("name").alias("rep"))


def rewritten(table: DataFrame, columns: list[str], same: DataFrame) -> DataFrame:
    """table with the names in `columns` replaced by their representatives; rows keep their number."""
    for c in columns:
        table = _follow(table, c, same, "_new").drop(c).withColumnRenamed("_new", c)
    return table


def aliases(table: DataFrame, column: str, same: DataFrame) -> DataFrame:
    """table, and each row again for every other name that `column`'s representative stands for."""
    look = same.where("node <> rep").select(F.col("g").alias("_g"), F.col("rep").alias("_rep"), F.col("node").alias("_node"))
    others = table.join(look, (F.col("g") == F.col("_g")) & (F.col(column) == F.col("_rep")))
    return table.unionByName(others.withColumn(column, F.col("_node")).drop("_g", "_node", "_rep"))
