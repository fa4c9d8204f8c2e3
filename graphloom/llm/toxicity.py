"""Toxicity by non-negative positive-unlabelled learning (operator 6).

Positives are texts confirmed as toxic, everything else is unlabelled. A logistic model on the presence of words and of
byte n-grams inside words is fitted with the class-prior-corrected risk  pi*R_P(+) + max(0, R_U(-) - pi*R_P(-)),  whose
second part, the risk of the hidden negatives, is kept from going below zero by stepping back on it (non-negative PU).

The fit sees a bounded sample (`max_positive`, `max_unlabelled` rows, `max_bytes` of text; by hash of the id, so reruns
agree) and keeps at most `max_features` features, so what is broadcast is bounded too. Scoring reads every whole text.

Defined cases: null and empty texts have no features and score the model's bias; without any positive or unlabelled row
every score is the prior (0 if there are no labels); null ids are scored and never learnt from.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore, work
from .decontaminate import normalised

BUCKET_BITS = 24
GRAMS = (5, 6, 7)


def feature_hits(texts: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature bucket) of all words and n-grams of the texts, or of those whose bucket is set in `table`."""
    data, off = normalised(texts)
    docs, n = len(off) - 1, len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buf = np.concatenate([np.full(1, 0x20, np.uint8), data, np.full(8, 0x20, np.uint8)])
    words8 = np.ndarray((n + 1,), "<u8", buffer=buf, strides=(1,))
    space = buf == 0x20
    spaces = np.cumsum(space[: n + 9], dtype=np.int32)
    at, bucket = [], []
    for size in GRAMS:
        # a space may be the first or the last byte only; windows that start with a space belong to the word after it
        last = np.arange(n + 1) + size - 2
        fine = (spaces[np.minimum(last, n + 8)] == spaces[: n + 1]) & ~space[1 : n + 2]
        key = textcore.mix((words8 & np.uint64((1 << 8 * size) - 1)) ^ np.uint64(size << 58))
        b = (key >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        if table is not None:
            fine &= table[b]
        i = np.flatnonzero(fine)
        at.append(i)
        bucket.append(b[i])
    ends = np.flatnonzero(data == 0x20)
    starts = np.concatenate([[0], ends[:-1] + 1])
    b = (textcore.span_hashes(data, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    if table is not None:
        keep = table[b]
        starts, b = starts[keep], b[keep]
    at.append(starts)
    bucket.append(b)
    doc = np.searchsorted(off, np.minimum(np.concatenate(at), n - 1), "right") - 1
    pair = np.unique(doc * (1 << BUCKET_BITS) + np.concatenate(bucket))
    return pair >> BUCKET_BITS, pair & ((1 << BUCKET_BITS) - 1)


@dataclass
class Model:
    buckets: np.ndarray  # sorted feature buckets
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        t = np.zeros(1 << BUCKET_BITS, bool)
        t[self.buckets] = True
        return t

    def scores(self, texts: pa.Array, table: np.ndarray) -> np.ndarray:
        doc, bucket = feature_hits(texts, table)
        logit = np.full(len(texts), self.bias)
        np.add.at(logit, doc, self.weights[np.searchsorted(self.buckets, bucket)] if len(bucket) else [])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_nnpu(pos: tuple[np.ndarray, np.ndarray, int], unl: tuple[np.ndarray, np.ndarray, int], features: int, prior: float, *, steps: int = 600, rate: float = 0.3, l2: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model; pos and unl are (row, feature, rows) of sparse 0/1 matrices."""
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior)) - 1
    m, v = np.zeros_like(w), np.zeros_like(w)
    (pr, pf, pn), (ur, uf, un) = pos, unl

    def logits(rows, cols, n):
        return np.bincount(rows, w[cols], n) + w[-1]

    def grad(rows, cols, slope):
        return np.append(np.bincount(cols, slope[rows], features), slope.sum())

    for step in range(1, steps + 1):
        zp, zu = np.clip(logits(pr, pf, pn), -30, 30), np.clip(logits(ur, uf, un), -30, 30)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        hidden = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        g_pos = grad(pr, pf, prior * (sp - 1) / pn)
        g_neg = grad(ur, uf, su / un) - grad(pr, pf, prior * sp / pn)
        g = g_pos + g_neg if hidden >= 0 else -g_neg
        g[:-1] += l2 * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(positive: list[str], unlabelled: list[str], prior: float, *, max_features: int = 4096, min_rows: int = 4, min_share: float = 0.01, least_ratio: float = 25.0, negative: np.ndarray | None = None) -> Model:
    """Selects features that positives hold far more often than the hidden negatives can, and fits their weights.

    `negative` tells which unlabelled rows carry a confirmed negative label: they serve to calibrate scores only (two
    numbers, slope and offset), since the risk's correction leaves the logit's scale open.
    """
    prior = min(max(prior, 1e-4), 0.9)
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))

    def count(texts):
        df = np.zeros(1 << BUCKET_BITS, np.int32)
        for part in textcore.slices(pa.record_batch([pa.array(texts, pa.string())], ["t"]), 0):
            hit, times = np.unique(feature_hits(part.column(0))[1], return_counts=True)
            df[hit] += times.astype(np.int32)
        return df

    np_, nu = len(positive), len(unlabelled)
    dp, du = count(positive), count(unlabelled)
    cand = np.flatnonzero(dp >= max(min_rows, min_share * np_))
    share = dp[cand] / np_
    hidden = np.maximum(0, du[cand] / nu - prior * share) / (1 - prior)
    ratio = share / (hidden + 2 / nu)
    good = ratio >= least_ratio
    cand, gain = cand[good], (dp[cand] * np.log(ratio))[good]
    buckets = np.sort(cand[np.argsort(-gain, kind="stable")[:max_features]])
    table = np.zeros(1 << BUCKET_BITS, bool)
    table[buckets] = True

    def rows(texts):
        r, f, n = [], [], 0
        for part in textcore.slices(pa.record_batch([pa.array(texts, pa.string())], ["t"]), 0):
            doc, bucket = feature_hits(part.column(0), table)
            r.append(doc + n)
            f.append(np.searchsorted(buckets, bucket))
            n += part.num_rows
        return np.concatenate(r), np.concatenate(f), n

    pos, unl = rows(positive), rows(unlabelled)
    weights, bias = fit_nnpu(pos, unl, len(buckets), prior)
    if negative is not None and negative.any():
        zp = np.bincount(pos[0], weights[pos[1]], pos[2]) + bias
        zn = (np.bincount(unl[0], weights[unl[1]], unl[2]) + bias)[negative]
        slope, offset = calibrated(zp, zn, prior)
        weights, bias = weights * slope, bias * slope + offset
    return Model(buckets, weights, bias)


def calibrated(zp: np.ndarray, zn: np.ndarray, prior: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the label on the logit (Newton's method, classes weighted by the prior)."""
    z = np.concatenate([zp, zn])
    y = np.concatenate([np.ones(len(zp)), np.zeros(len(zn))])
    weight = np.where(y == 1, prior / len(zp), (1 - prior) / len(zn))
    x = np.column_stack([z, np.ones(len(z))])
    t = np.array([1.0, 0.0])
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        g = x.T @ (weight * (s - y)) + 1e-4 * (t - [1.0, 0.0])
        h = (x * (weight * s * (1 - s))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        t = t - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(t[0]), float(t[1])) if t[0] > 0 else (1.0, 0.0)


def _rows(rows: DataFrame, most: int) -> tuple[list[str], list]:
    """Texts and second column of the rows, within `most` characters of text in all: a text that doesn't fit any more is
    passed over and shorter ones after it still count."""
    texts, marks, size = [], [], 0
    for text, mark in rows.toLocalIterator():
        if size + len(text or "") <= most:
            size += len(text or "")
            texts.append(text or "")
            marks.append(mark)
    return texts, marks


def train(documents: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, max_positive: int = 4000, max_unlabelled: int = 8000, max_bytes: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits the model from rows outside the held-out fold (crc32 of the id as text, modulo `folds`)."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(fold & F.col("y").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    shares = known.agg(F.avg("y")).first()[0]
    if shares is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    order = F.xxhash64(F.lit(6), "doc_id")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    toxic = known.where("y = 1").orderBy(order).limit(max_positive).select("doc_id")
    # Unlabelled: any row of the learning folds. Ids only until the sample is fixed.
    others = docs.select("doc_id").where(fold & F.col("doc_id").isNotNull()).orderBy(order).limit(max_unlabelled).join(known, "doc_id", "left").select("doc_id", "y")
    pick = lambda ids: docs.join(F.broadcast(work.saved(ids, "toxic-sample")), "doc_id").orderBy(order).select("text", "y")  # noqa: E731  bounded: at most max_* ids
    positive, _ = _rows(pick(toxic.withColumn("y", F.lit(1))), max_bytes)
    unlabelled, marks = _rows(pick(others), max_bytes)
    return fit(positive, unlabelled, float(shares), negative=np.array([m == 0 for m in marks], bool))


def score(documents: DataFrame, model: Model, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = documents.sparkSession
    work.ship(spark)
    sent = spark.sparkContext.broadcast(model)
    small = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        m = sent.value
        table = m.table()
        for batch in batches:
            for part in textcore.slices(batch, 1):
                s = m.scores(part.column(1), table)
                ids = part.column(0)
                out = pa.array([v is not None and zlib.crc32(str(v).encode()) % folds == held_out for v in ids.to_pylist()])
                yield pa.RecordBatch.from_arrays([ids, out, pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return work.map_arrow(small, run, "doc_id long, held_out boolean, score double, predicted int")


def op6(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, train(documents, labels))
