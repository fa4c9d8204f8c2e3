"""Sharding by fixed virtual slots: records are hashed into thousands of slots, bytes are summed by slot, and a versioned
slot-to-shard map, edited when shards are rebalanced, says where each slot lives.

Only the map knows the shards, so a rebalance or a new shard moves whole slots and rewrites a few thousand short rows, not
every record's hash. Text is read once; what is shuffled is a short row a record.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from . import work

SHARDS, SLOTS = 24, 4096
#: A slot of more than one record and more than this share of a shard's bytes is dealt out again by record.
HOT = 0.25


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32 (null for a null text) and the record's 64-bit hash.

    The hash is of id and text, so rows that share an id, or have none, spread as well.
    """
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(
        ident.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(ident, text).alias("record_hash"),
    )


def initial_map(slots: int = SLOTS, shards: int = SHARDS) -> np.ndarray:
    """The map before anything is known of the records: slots dealt out in turn."""
    return np.arange(slots) % shards


def loads(shard_of: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    out = np.zeros(shards, np.int64)
    np.add.at(out, shard_of, weight)
    return out


def _excess(shard_of: np.ndarray, weight: np.ndarray, shards: int) -> list[int]:
    """Slots that shards above the mean can give away, the largest that fit first."""
    load, out = loads(shard_of, weight, shards), []
    mean = weight.sum() / shards
    for slot in np.lexsort((np.arange(len(weight)), -weight)).tolist():
        s = shard_of[slot]
        if weight[slot] and load[s] - weight[slot] >= mean:
            load[s] -= weight[slot]
            out.append(slot)
    return out


def rebalanced(shard_of: np.ndarray, weight: np.ndarray, shards: int, spread: float = 1e-4) -> np.ndarray:
    """The map edited until shards weigh the same but for `spread` of their mean, or no move or swap of slots helps.

    Shards above the mean give slots away, the largest that fit first; each goes to the shard that is then lightest. After
    that the heaviest and the lightest shard move or swap the slots that halve their difference best. Bounded by the slots.
    """
    out, weight = np.array(shard_of), np.asarray(weight, np.int64)
    load = loads(out, weight, shards)
    for slot in _excess(out, weight, shards):
        to = int(load.argmin())
        if load[to] + weight[slot] < load[out[slot]]:
            load[out[slot]] -= weight[slot]
            load[to] += weight[slot]
            out[slot] = to
    for _ in range(20 * len(weight)):
        high, low = int(load.argmax()), int(load.argmin())
        gap = int(load[high] - load[low])
        if gap <= max(1, spread * weight.sum() / shards):
            break
        give = np.flatnonzero((out == high) & (weight > 0))
        take = np.concatenate([[-1], np.flatnonzero((out == low) & (weight > 0))])  # -1: nothing comes back
        back = np.where(take < 0, 0, weight[take])
        order = np.argsort(back, kind="stable")
        take, back = take[order], back[order]
        want = weight[give] - gap // 2
        at = np.searchsorted(back, want)
        best = None
        for step in (-1, 0):
            k = np.clip(at + step, 0, len(back) - 1)
            moved = weight[give] - back[k]
            miss = np.where((moved > 0) & (moved < gap), np.abs(2 * moved - gap), np.iinfo(np.int64).max)
            j = int(miss.argmin())
            if miss[j] < np.iinfo(np.int64).max and (best is None or miss[j] < best[0]):
                best = (miss[j], int(give[j]), int(take[k[j]]), int(moved[j]))
        if best is None:
            break
        _, a, b, moved = best
        out[a] = low
        if b >= 0:
            out[b] = high
        load[high] -= moved
        load[low] += moved
    return out


def grown(shard_of: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """The map for one shard more than `shards`: slots move into the new shard only, until it weighs the new mean."""
    out, weight = np.array(shard_of), np.asarray(weight, np.int64)
    for slot in _excess(out, weight, shards + 1):
        out[slot] = shards
    return out


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    return sorted(int(s.getPath().getName()[8:]) for s in files.listStatus(path) if s.getPath().getName().startswith("version="))


def store_map(spark: SparkSession, folder: str, shard_of: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> int:
    """Writes the map (slot, shard, bytes, rows) as the next version under `folder`; earlier ones stay. Two writers of one
    version can't both end well: the second finds its folder there."""
    version = max([0, *_versions(spark, folder)]) + 1
    lines = [(k, int(s), int(w), int(r)) for k, (s, w, r) in enumerate(zip(shard_of, weight, rows, strict=True))]
    spark.createDataFrame(lines, "slot int, shard int, bytes long, rows long").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")
    return version


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(slot, shard, bytes, rows) of a version, by default the last; one row a slot."""
    version = version or max(_versions(spark, folder))
    return spark.read.schema("slot int, shard int, bytes long, rows long").parquet(f"{folder}/version={version}")


def slot_weights(slotted: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot; one row a slot reaches the driver."""
    weight, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for s, w, n in slotted.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        weight[s], rows[s] = w, n
    return weight, rows


def slotted(found: DataFrame, shards: int, slots: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The records with their virtual_slot, and bytes and rows a slot.

    A hash tells equal records (same id, same text) not apart. Where such a group, or chance, makes a slot of several records
    so heavy that shards could not be made equal, the slot's records alone are numbered and dealt out by number and hash.
    """
    placed = found.withColumn("virtual_slot", F.pmod("record_hash", F.lit(slots)).cast("int"))
    weight, rows = slot_weights(placed, slots)
    hot = [int(s) for s in np.flatnonzero((weight > HOT * weight.sum() / shards) & (rows > 1))]
    if not hot:
        return placed, weight, rows
    is_hot = F.col("virtual_slot").isin(hot)  # fewer than shards / HOT
    again = numbered(placed.where(is_hot), ["virtual_slot"], ["record_hash", "doc_id", "text_crc32", "size"], "_turn")
    again = again.withColumn("virtual_slot", F.pmod(F.xxhash64("record_hash", "_turn"), F.lit(slots)).cast("int")).drop("_turn")
    placed = placed.where(~is_hot).unionByName(again)
    return placed, *slot_weights(placed, slots)


def sharded(docs: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every record's shard and its place there: doc_id, size, text_crc32, virtual_slot, shard, slot (0, 1, ... in each shard,
    in the order of the records' hashes), map_version.

    The map goes to `folder`: the slots dealt out in turn first, where there is no earlier version, then the same map
    rebalanced by the bytes just counted; a later call edits the last version, so records that need not move stay where they
    are. Shards come as near to equal bytes as slots allow. Null texts count as no bytes, null ids are ids like others;
    repeated rows each get a place; an empty table gives no rows (and a map); columns besides id and text play no part.
    """
    spark = docs.sparkSession
    found = work.saved(records(docs, id_col, text_col), "shard-records")
    placed, weight, rows = slotted(found, shards, slots)
    known = _versions(spark, folder)
    now = initial_map(slots, shards)
    if known:
        for r in load_map(spark, folder).collect():  # one row a slot
            now[r.slot] = r.shard
    else:
        store_map(spark, folder, now, weight, rows)
    version = store_map(spark, folder, rebalanced(now, weight, shards), weight, rows)
    where = F.broadcast(load_map(spark, folder, version).select(F.col("slot").alias("virtual_slot"), "shard"))  # one row a slot
    homes = placed.join(where, "virtual_slot").withColumn("map_version", F.lit(version))
    return numbered(homes, ["shard"], ["record_hash", "doc_id", "text_crc32", "size"], "slot")


def op13(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law), virtual_slot, map_version."""
    folder = work.new_dir(docs.sparkSession, "slot-map")
    out = sharded(docs, folder)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
