"""Vector code compression: product codes by Lloyd's rounds that are maintained by their changes.

Every vector is cut into parts; each part position has a codebook of its own. The state is a table of vectors with the
codes of the round before, and integer sums and counts of every entry's parts. A round assigns all parts anew; only parts
whose code changed contribute, minus to the old entry and plus to the new one, added up by each task first, so what is
shuffled is at most a row for each entry and task, and late rounds shuffle next to nothing. Codebooks and sums are a few
thousand integers, whatever the data. Integers make every sum exact and every rerun equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import work

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components up to here keep squared distances of vectors of up to 2**11 components within 64 bits.
LARGEST = 2**25


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values as doubles (null: NaN), row lengths, and rows that are usable: neither null nor with a non-finite component."""
    lists = column.cast(pa.large_list(column.type.value_type))
    sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    values = lists.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(sizes)
    good = ~lists.is_null().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
    return values, sizes, good


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, x: floor(SCALE * component) as little-endian 32-bit integers; unusable rows are dropped."""
    small = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = small.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes, good = _flat(batch.column(2))
            scaled = np.floor(SCALE * values[np.repeat(good, sizes)])
            if scaled.size and np.abs(scaled).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST // SCALE}: its squared distances would not be exact")
            kept = pa.array(good)
            ends = np.concatenate([[0], np.cumsum(sizes[good])]) * 4
            x = pa.Array.from_buffers(pa.large_binary(), int(good.sum()), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(scaled.astype("<i4"))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), x], names=["vec_id", "label", "x"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("x", T.BinaryType())])
    return small.mapInArrow(run, schema)


def _matrix(column: pa.Array, width: int, kind: str = "<i4") -> np.ndarray:
    joined = column.cast(pa.large_binary())
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    return np.frombuffer(joined.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(joined), width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances summed over parts; ties go to the lower index. books: (parts, entries, width)."""
    parts, _, width = books.shape
    codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width].astype(np.int64)
        away = (own * own).sum(1)[:, None] - 2 * (own @ books[p].T) + (books[p] * books[p]).sum(1)[None, :]
        codes[:, p] = away.argmin(1)
        error += away.min(1)
    return codes, error


def changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """(parts, entries, width + 1): what sums and counts gain and lose by the parts whose code changed."""
    parts, entries, width = shape
    out = np.zeros((parts, entries, width + 1), np.int64)
    for p in range(parts):
        rows = np.arange(len(x)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        part = np.concatenate([x[rows, p * width : (p + 1) * width].astype(np.int64), np.ones((len(rows), 1), np.int64)], 1)
        np.add.at(out[p], new[rows, p], part)
        if old is not None:
            np.subtract.at(out[p], old[rows, p], part)
    return out


def _round(state: DataFrame, books: np.ndarray, size: int, last: bool) -> DataFrame:
    """State rows with their new codes (kind 0) and, from each task, its changes (kind 1); in the last round with errors."""
    shape, label = books.shape, state.schema["label"]
    width = shape[0] * shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gained = np.zeros((shape[0], shape[1], shape[2] + 1), np.int64)
        kinds = [pa.int32(), pa.int64(), None, pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kinds[2] = batch.schema.field("label").type
            x = _matrix(batch.column("x"), size)
            if size < width:
                x = np.pad(x, ((0, 0), (0, width - size)))
            codes, error = nearest(x, books)
            before = batch.column("codes")
            old = None if before.null_count else _matrix(before, shape[0], "u1")
            if not last:
                gained += changes(x, old, codes, shape)
            packed = pa.array([r.tobytes() for r in codes], pa.binary())
            x_out = pa.nulls(n, pa.binary()) if last else batch.column("x").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("vec_id"), batch.column("label"), x_out, packed, pa.array(error), *(pa.nulls(n, k) for k in kinds[6:])], names=names)
        rows = [(p, e, gained[p, e].tolist()) for p, e in zip(*np.nonzero(gained.any(2)), strict=True)]
        if rows:
            n = len(rows)
            p, e, g = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), *(pa.nulls(n, k) for k in kinds[1:6]), pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(g, pa.list_(pa.int64()))], names=names)

    L, B, I = T.LongType(), T.BinaryType(), T.IntegerType()
    schema = T.StructType([T.StructField("kind", I), T.StructField("vec_id", L), T.StructField("label", label.dataType), T.StructField("x", B), T.StructField("codes", B), T.StructField("error", L), T.StructField("part", I), T.StructField("entry", I), T.StructField("gain", T.ArrayType(L))])
    names = schema.names
    out = state.select("vec_id", "label", "x", "codes").mapInArrow(run, schema)
    path = work.new_dir(state.sparkSession, "codes")
    out.write.partitionBy("kind").parquet(path)
    table = state.sparkSession.read.schema(schema).parquet(path)
    table._scratch = path
    return table


def _gains(table: DataFrame, width: int) -> list:
    """Summed changes of the round, one row an entry at most."""
    sums = F.array(*(F.sum(F.col("gain")[k]) for k in range(width + 1)))
    return table.where("kind = 1").groupBy("part", "entry").agg(sums.alias("gain")).collect()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    Rows whose vector is null, or holds a null or non-finite component, are dropped, and so are vectors of another length than
    the one with the smallest id; where the length is no multiple of the parts, zeros fill the last one up (they change no
    distance). Codebooks start as the parts of the vectors of the smallest ids (null ids last, ties by the vector's integers);
    with fewer vectors than entries there are as many entries. Ties go to the lower index, unused entries stay. Repeated
    rows and ids are rows like others. Null labels are one label. No usable vector: no rows. Other columns play no part.
    A scaled component beyond 2**25 raises, as its distances would not be exact.
    """
    spark = vectors.sparkSession
    work.ship(spark)
    state = work.saved(integers(vectors, id_col, vector_col, label_col), "codes-integers")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").first()
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    if first is None or not len(first.x):
        return spark.createDataFrame([], schema)
    size = len(first.x) // 4
    width = -(-size // parts)
    state0, state = state, state.where(F.octet_length("x") == 4 * size)
    seeds = np.array([np.frombuffer(r.x, "<i4") for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()], np.int64)
    books = np.pad(seeds, ((0, 0), (0, parts * width - size))).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    state = state.withColumn("codes", F.lit(None).cast("binary"))
    sums = np.zeros((parts, len(seeds), width + 1), np.int64)
    for _ in range(rounds):
        table = _round(state, books, size, False)
        for r in _gains(table, width):
            sums[r.part, r.entry] += np.array(r.gain, np.int64)
        used = sums[..., -1:] > 0
        books = np.where(used, sums[..., :-1] // np.maximum(sums[..., -1:], 1), books)
        work.discard(state0)
        state0, state = table, table.where("kind = 0")
    last = _round(state, books, size, True)
    work.discard(state0)
    digest = sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    rows = last.where("kind = 0")
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("label2"), "label_error")
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("label2")), "left")
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12(embeddings: DataFrame) -> DataFrame:
    return compressed(embeddings)
