"""Gapless positions within groups, without a window over a group: one range shuffle, whatever the groups' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import saved

#: Runs (one for each group and file) that are sent to every executor; beyond it they are joined by a shuffle.
MOST_SENT = 200_000


def numbered(df: DataFrame, by: list[str], order: list[str | Column], position: str = "position", size: str | None = None, partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """df with `position`, 0, 1, 2, ... within each group of equal `by` in ascending `order`, and with `size`, the group's rows;
    with `weight`, a column of whole numbers, the sum of the weights before a row, and of all of the group's.

    Rows are sorted over all tasks by group and order and written to the shared folder; a row's position is its place in its
    file's run of the group plus the group's rows in earlier files, so a group of any size spreads over tasks. Nulls of `by`
    form one group; nulls of `order` sort first; rows equal in both get positions in any order. An empty table stays empty.
    """
    up = lambda c: c.asc_nulls_first() if isinstance(c, Column) else F.col(c).asc_nulls_first()
    keys = [up(c) for c in [*by, *order]]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    table = saved(ranged.sortWithinPartitions(*keys), "numbered")
    table = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if weight:  # a file's run of a group is one task's rows
        own = Window.partitionBy("_file", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        table = table.withColumn("_row", F.coalesce(F.sum(weight).over(own), F.lit(0)).cast("long"))
    runs = table.groupBy("_file", *by).agg(F.min("_row").alias("_first"), (F.sum(weight) if weight else F.count(F.lit(1))).alias("_rows"))
    group = Window.partitionBy(*by)
    before = group.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_file").alias("_file2"), *(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("_size"),
    )
    runs = saved(runs, "numbered-runs")
    if runs.count() <= MOST_SENT:
        runs = F.broadcast(runs)
    same = F.col("_file") == F.col("_file2")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    more = [F.col("_size").alias(size)] if size else []
    return table.join(runs, same).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(position), *more)
