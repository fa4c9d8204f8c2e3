"""Bit tables: a bounded stand-in for a set of keys, with which map tasks pass rows that surely have no match."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import work


def bit_table(keys: DataFrame, most_bits: int = 28) -> np.ndarray:
    """A bit table of the column `key`, 16 bits a key up to 2^most_bits (32 MB), put together from 8 KB blocks."""
    count = keys.count()
    bits = min(most_bits, max(16, (16 * count).bit_length()))
    place = F.shiftrightunsigned(F.xxhash64("key"), 64 - bits)

    def build(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy()
            for b in np.unique(h >> 16).tolist():
                np.put(blocks.setdefault(b, np.zeros(1 << 16, bool)), h[h >> 16 == b] & 0xFFFF, True)
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([np.packbits(x).tobytes() for x in blocks.values()], pa.binary())], ["b", "bits"])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    placed = work.packed(keys.select(place.alias("h")).repartition(n, F.shiftright("h", 16)), count)
    # at most 4,096 blocks, in one job: one for every partition would take longer than all else where partitions are many
    for r in work.map_arrow(placed, build, "b long, bits binary").collect():
        table[r.b << 13 : (r.b + 1) << 13] |= np.frombuffer(r.bits, np.uint8)
    return table


def may_hold(column: Column, table: np.ndarray, spark) -> Column:
    """False where the column's value surely isn't in the table; true for all values in it and few others."""
    sent = spark.sparkContext.broadcast(table)
    size = int(len(table)).bit_length() + 2

    @F.pandas_udf("boolean")
    def look(h):
        v = h.to_numpy()
        return h.__class__(sent.value[v >> 3] >> (7 - (v & 7)).astype(np.uint8) & 1 == 1, index=h.index)

    return look(F.shiftrightunsigned(F.xxhash64(column), 64 - size))


def without(documents: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """documents without the rows whose keys are in gone, a saved table with one column a key; columns as given. Null keys
    equal each other.

    Only rows that the bit table of those keys lets through meet the anti-join, so the texts of the others, most of them,
    are never shuffled. A table too full to tell costs a shuffle and nothing else.
    """
    spark = documents.sparkSession
    work.ship(spark)
    flag = work.fresh(documents, "may_go")
    names = [work.fresh(documents, f"gone_{k}") for k in range(len(keys))]
    gone = gone.toDF(*names)
    table = bit_table(gone.select(F.xxhash64(*names).alias("key")))
    marked = documents.withColumn(flag, may_hold(F.xxhash64(*keys), table, spark))
    stay = marked.where(~F.col(flag)).select(documents.columns)
    rest = marked.where(F.col(flag)).select(documents.columns)
    match = keys[0].eqNullSafe(F.col(names[0]))
    for key, name in zip(keys[1:], names[1:], strict=True):
        match &= key.eqNullSafe(F.col(name))
    return stay.unionByName(rest.join(gone, match, "left_anti"))
