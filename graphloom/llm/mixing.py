"""Mixing sources to target weights by a low-discrepancy source schedule (operator 5).

Each source's documents, in a shuffled order that depends on ids alone, form one stream of words, cut into blocks of
equal length. Points of the golden-ratio sequence, mapped through the cumulative shares of the sources, name the source
of each slot of the schedule; the r-th slot of a source takes the source's r-th block, again from the first after the
last. Prefixes of the schedule thus hold every source near its share, and the whole schedule meets the targets exactly
(to a word; the last slot of a source is trimmed).

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in order;
rows with equal ids are separate documents; without documents the result is empty; an all-empty corpus takes nothing.
"""

from __future__ import annotations

import re
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bits, work

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 2654435769  # 2^32 / golden ratio, odd
CHUNK = 1 << 16


def targets(sizes: list[int], weights: list[int], share: Fraction, cap: Fraction) -> list[Fraction]:
    """Shares `share` of all words out by weight; what a source would get beyond cap * size is reshared among the rest."""
    total = share * sum(sizes)
    got: list[Fraction] = [Fraction(0)] * len(sizes)
    open_ = set(range(len(sizes)))
    left = total
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] > cap * sizes[k] * weight]
        if not over:
            for k in open_:
                got[k] = left * weights[k] / weight
            break
        for k in over:
            got[k] = cap * sizes[k]
            left -= got[k]
            open_.discard(k)
    return got


def sizes_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, text_hash, source, size) of every row."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def plan(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: Fraction = Fraction(2), block: int = 1024, max_sources: int = 1_000_000) -> tuple[list[dict], int]:
    """One record a source (number, size, target, blocks, slots, words to take), and the block length.

    The table of sources comes to the driver: they carry configured weights, and more than `max_sources` are refused.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    want = targets([r["size"] for r in rows], [weights[k % len(weights)] for k in range(len(rows))], share, cap)
    block = max(block, ceil(sum(want) / (1 << 28))) if want else block
    out = []
    for k, (r, t) in enumerate(zip(rows, want, strict=True)):
        take = min(round(t), int(cap * r["size"]))
        passes, rest = divmod(take, r["size"]) if r["size"] else (0, 0)
        blocks = -(-r["size"] // block)
        out.append({"s": k, "source": r["source"], "docs": r["docs"], "source_size": r["size"], "target": float(t), "take": take, "blocks": blocks, "need": passes * blocks - (-rest // block)})
    return out, block


def _earlier(n: int, below: np.ndarray) -> np.ndarray:
    """For each t in below: how many of the first n points of the sequence, as multiples of 2^-32, lie below t."""

    def floors(b: np.ndarray) -> np.ndarray:
        """Sum over i < n of floor((GOLDEN * i + b) / 2^32), by the Euclidean algorithm on all of b at once."""
        total = np.zeros(len(b), np.int64)
        count, m, a, b = np.full(len(b), n, np.int64), np.full(len(b), 1 << 32, np.int64), np.full(len(b), GOLDEN, np.int64), b.copy()
        live = count > 0
        while live.any():
            step_b, step_a = b // m, a // m
            total += np.where(live, step_b * count + step_a * (count * (count - 1) // 2), 0)
            a, b = a - step_a * m, b - step_b * m
            top = a * count + b
            live &= top >= m
            count, b = np.where(live, top // m, 0), np.where(live, top % m, 0)
            a, m = np.where(live, m, 0), np.where(live, a, 1)
        return total

    # floor(y / M) - floor((y - t) / M) is 1 where y mod M < t; one M is added so that nothing is negative
    whole = floors(np.zeros(1, np.int64))[0]
    return whole + n - floors((1 << 32) - below)


def schedule(spark, sources: list[dict], block: int) -> DataFrame:
    """(slot, s, pass, block, words): slots in order, the block each takes and how many of its words.

    A point's rank among its source's points is counted ahead for each run of points, so slots need no shuffle.
    """
    need = np.array([x["need"] for x in sources], np.int64)
    info = [np.array([x[k] for x in sources], np.int64) for k in ("source_size", "take", "blocks")]  # max_sources rows at most
    ends = np.cumsum(need)
    total = int(ends[-1]) if len(ends) else 0
    # The gaps between n golden-ratio points are below 1.9 / n, so 4 * total points give every source its slots.
    points = 4 * total + 8 if total else 0
    chunks = -(-points // CHUNK)
    work.ship(spark)
    sent = spark.sparkContext.broadcast((need, *info))

    def draw(batches):
        need, source_size, take, blocks = sent.value
        ends = np.cumsum(need)
        # x belongs to the first source whose end e has x * total < e * 2^32
        edge = np.array([0, *(-(-(int(e) << 32) // total) for e in ends)], np.int64)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                i = np.arange(c * CHUNK, min(points, (c + 1) * CHUNK), dtype=np.uint64)
                x = (i * np.uint64(GOLDEN)) & np.uint64(0xFFFFFFFF)
                s = np.searchsorted(ends, ((x * np.uint64(total)) >> np.uint64(32)).astype(np.int64), "right")
                order = np.argsort(s, kind="stable")
                here, first = np.unique(s[order], return_index=True)
                before = np.diff(_earlier(c * CHUNK, edge))
                rank = np.empty(len(i), np.int64)
                rank[order] = np.arange(len(i)) - np.repeat(first - before[here], np.diff(np.append(first, len(i))))
                use = np.flatnonzero(rank < need[s])
                s, r = s[use], rank[use]
                turn, part = r // blocks[s], r % blocks[s]
                words = np.minimum(np.minimum(block, source_size[s] - part * block), take[s] - turn * source_size[s] - part * block)
                yield pa.RecordBatch.from_pydict({"slot": i[use].astype(np.int64), "s": s.astype(np.int64), "pass": turn, "block": part, "words": words})

    numbers = spark.range(0, chunks, 1, max(1, min(chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return work.map_arrow(numbers, draw, "slot long, s long, pass long, block long, words long")


def streams(sizes: DataFrame, sources: list[dict], per_bucket: int = 8_000, seed: int = 17) -> DataFrame:
    """Each document's place `start` in its source's shuffled stream of words.

    Two-level running sums: words per (source, hash bucket) first, then inside a bucket, so a source that holds most
    documents is spread over buckets of at most about `per_bucket` documents and never sorted in one task.
    """
    spark = sizes.sparkSession
    info = spark.createDataFrame([(x["s"], x["source"], max(1, -(-x["docs"] // per_bucket)) * 4) for x in sources], "s long, source0 string, buckets long")
    order = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    # sent: one row a source, of which there are max_sources at most
    placed = sizes.join(F.broadcast(info), F.col("source").eqNullSafe(F.col("source0"))).withColumn("o", order).withColumn("bucket", F.pmod("o", "buckets"))
    sums = placed.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("s", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("o", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("upto", F.sum("size").over(inside)).join(base, ["s", "bucket"]).select("doc_id", "text_hash", "source", "s", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))


def mix(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: Fraction = Fraction(2), block: int = 1024) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(placed documents, pieces the mix takes, sources) for a table (doc_id, text_hash, source, size).

    pieces: slot, s, pass, doc_id, text_hash, source, start (the document's place in its source's stream), first and words: the slot takes
    the document's words first .. first + words - 1.
    """
    spark = sizes.sparkSession
    sources, block = plan(sizes, weights=weights, share=share, cap=cap, block=block)
    placed = work.saved(streams(sizes, sources), "mix-streams")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    slots = schedule(spark, sources, block)
    # sorted and merged: the slots grow with the data, though Spark would guess them to be few
    joined = cut.join(slots.hint("merge"), ["s", "block"])
    first = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    last = F.least(F.col("size"), F.col("block") * block + F.col("words") - F.col("start"))
    pieces = joined.select("slot", "s", "pass", "doc_id", "text_hash", "source", "start", first.alias("first"), (last - first).alias("words")).where("words > 0")
    return placed, pieces, sources


def op5(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    spark = documents.sparkSession
    sizes = work.saved(sizes_of(documents), "mix-sizes")
    placed, pieces, sources = mix(sizes)
    # a document with words has a start of its own in its source's stream
    taken = pieces.groupBy(F.col("s").alias("ps"), F.col("start").alias("pstart")).agg(F.sum("words").alias("words"))
    info = spark.createDataFrame([(x["s"], x["source_size"], x["target"]) for x in sources], "s long, source_size long, target double")
    match = (F.col("s") == F.col("ps")) & (F.col("start") == F.col("pstart")) & (F.col("size") > 0)
    return placed.join(taken, match, "left").join(F.broadcast(info), "s").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def first_words(text: str | None, n: int) -> str | None:
    """The text up to the end of its n-th word."""
    if text is None:
        return None
    end = 0
    for k, m in enumerate(re.finditer(WORD, text)):
        if k >= n:
            break
        end = m.end()
    return text[:end]


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The mix as documents: a document taken twice comes twice; one that the last slot cuts comes with its first words.

    Columns as in `documents`. Rows are told apart by id (null is one), text and source; of rows that repeat all three the
    mix holds as many as it takes, with the other columns of one of them.
    """
    spark = documents.sparkSession
    work.ship(spark)
    sizes = work.saved(sizes_of(documents, id_col, text_col, source_col), "mix-sizes")
    _, pieces, _ = mix(sizes)
    row = ["doc_id", "text_hash", "source"]
    # words a row and pass; a repeated row has a start of its own for each
    taken = pieces.groupBy(*row, "start", "pass").agg(F.sum("words").alias("words"))
    whole = sizes.where("size > 0").groupBy(*(F.col(c).alias(f"{c}0") for c in row)).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    whole = work.saved(whole, "mix-whole")
    names = [work.fresh(documents, f"mix_{c}") for c in (*row, "whole", "words", "rows")]
    same = F.lit(True)
    for c in row:
        same &= F.col(c).eqNullSafe(F.col(f"{c}0"))
    copies = taken.join(whole, same).select(*row, F.col("words") == F.col("size"), "words", "rows").toDF(*names)
    key = [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), F.col(source_col).cast("string")]
    twice = whole.where("rows > 1").select(*(f"{c}0" for c in row))
    if not twice.isEmpty():
        repeated = [work.fresh(documents, f"mix_{c}1") for c in row]
        of = twice.toDF(*repeated)
        match = F.lit(True)
        for k, c in zip(key, repeated, strict=True):
            match &= k.eqNullSafe(F.col(c))
        once = documents.join(of, match).dropDuplicates(repeated).select(documents.columns)
        documents = bits.without(documents, key, twice).unionByName(once)
    match = F.lit(True)
    for k, c in zip(key, names, strict=False):
        match &= k.eqNullSafe(F.col(c))
    joined = documents.join(copies, match)
    cut = F.when(~F.col(names[3]), F.col(text_col).cast("string"))  # null but for the few documents that a last slot cuts

    @F.pandas_udf("string")
    def head(texts, words):
        return texts.combine(words, first_words)

    text = F.when(F.col(names[3]), F.col(text_col)).otherwise(head(cut, F.col(names[4])))
    out = joined.withColumn(text_col, text)
    if chars_col and chars_col in documents.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(documents.schema[chars_col].dataType))
    return out.select(*documents.columns)
