"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source (operator 8).

Statistics of whole texts become a small table of transformed vectors. Per (language, source) the minimum covariance
determinant is sought by concentration steps, each a distributed pass: distances from the present centre and
covariance, their h-quantile per group, then centre and covariance of the rows below it, until the determinant settles,
from several starts of which the one with the least determinant wins. Vectors far from their group's final estimate (Mahalanobis) are rejected.

Defined cases: null text has no words and fails the base rule; null language or source is a value of its own; groups
below `min_rows` pool by language (null apart from an empty one), then all together, and a pool that is still below it
rejects by the base rule only; rows that tie with a quantile are on its near side; rows that share an id are judged each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits, textcore, work

SYMBOLS = b"#*$%&|<>"
FEATURES = ("x_length", "x_symbol", "x_repeat", "x_duplicate", "x_upper", "x_punct", "x_adjacent")
#: Least standard deviation of each feature: below it a difference means nothing, however alike a group's rows are.
FLOOR = (0.05, 0.04, 0.15, 0.25, 0.06, 0.05, 0.1)
P = len(FEATURES)
CHI2_MEDIAN = 6.346  # of chi-square with P degrees of freedom
_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
_PUNCT[48:58] = False
_PUNCT[_ALPHA] = False
_PUNCT[_SYM] = False
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False


def _per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(s), bool)
    out[order] = twice
    return out


def text_statistics(texts: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """Counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_adjacent, upper, alpha, punct."""
    w = textcore.Words(texts)
    data, off, docs = w.data, w.off, len(w.off) - 1
    n = w.counts()
    doc = w.doc()
    out = {"n_words": n, "word_chars": _per_doc(w.word & _HEAD[data], off), "n_symbols": _per_doc(_SYM[data], off), "upper": _per_doc(_UPPER[data], off), "alpha": _per_doc(_ALPHA[data], off), "punct": _per_doc(_PUNCT[data], off)}
    salt = textcore.mix(np.arange(docs, dtype=np.uint64) + np.uint64(1))
    # lines
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]))
    owner = np.searchsorted(off, starts, "right") - 1
    tail = starts >= off[-1]  # a line after the last break, or an empty text at the end
    starts, owner = starts[~tail], owner[~tail]
    ends = np.minimum(np.append(starts[1:], off[-1]), off[owner + 1])
    broken = (ends > starts) & (data[np.maximum(ends - 1, 0)] == 0x0A)
    ends = ends - broken
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(w.word, out=sums[1:])
    full = sums[ends] > sums[starts]
    starts, ends, owner = starts[full], ends[full], owner[full]
    lines = textcore.mix(textcore.span_hashes(data, starts, ends) ^ salt[owner])
    _, kept = np.unique(lines, return_index=True)
    out["n_lines"] = np.bincount(owner, minlength=docs)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[kept], minlength=docs)
    # words in repeated windows
    covered = out["n_adjacent"] = np.zeros(docs, np.int64)
    h = w.hashes()
    if len(doc) > 1:
        out["n_adjacent"] = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=docs)
    if len(doc) >= window:
        m = len(h) - window + 1
        g = salt[doc[:m]].copy()
        for j in range(window):
            g *= np.uint64(0x9FB21C651E98DF25)
            g += h[j : m + j]
        g = textcore.mix(g)
        at = np.flatnonzero(doc[:m] == doc[window - 1 :])
        hit = at[_repeats(g[at])]
        diff = np.zeros(len(h) + 1, np.int64)
        np.add.at(diff, hit, 1)
        np.add.at(diff, hit + window, -1)
        covered = np.bincount(doc[np.cumsum(diff[:-1]) > 0], minlength=docs)
    out["n_repeat_words"] = covered
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed vectors: log of mean word length, square roots of shares."""
    n = np.maximum(s["n_words"], 1)
    chars = np.maximum(s["word_chars"], 1)
    share = lambda a, b: np.sqrt(np.clip(s[a] / np.maximum(b, 1), 0, 1))
    return np.column_stack([np.log(chars / n), share("n_symbols", chars), share("n_repeat_words", n), share("n_dup_lines", s["n_lines"]), share("upper", s["alpha"]), share("punct", chars), share("n_adjacent", n)])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, text_hash, the counts and the feature vector of every row."""
    work.ship(documents.sparkSession)
    small = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))

    def measure(batches):
        for batch in batches:
            for part in textcore.slices(batch, 4):
                s = text_statistics(part.column(4))
                x = features(s)
                cols = [part.column(0), part.column(1), part.column(2), part.column(3), *(pa.array(s[k], pa.int64()) for k in COUNTS), *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(P))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "source", "text_hash", *COUNTS, *FEATURES])

    kinds = ", ".join([*(f"{k} long" for k in COUNTS), *(f"{k} double" for k in FEATURES)])
    return work.map_arrow(small, measure, f"doc_id long, lang string, source string, text_hash long, {kinds}")


def _grouped(stats: DataFrame, min_rows: int) -> DataFrame:
    """Adds `grp`: language and source, or a pool for small groups; null where even the pool is small."""
    key = F.to_json(F.struct("lang", "source"))
    counts = stats.where("not base_failed").groupBy(key.alias("grp0"), F.to_json(F.struct("lang")).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    counts = work.saved(work.packed(counts, stats.count()), "quality-counts")
    counts = work.alone(counts, counts.count(), 10_000)
    pooled = counts.withColumn("grp1", F.when(F.col("n") >= min_rows, F.col("grp0")).otherwise(F.concat(F.lit("lang:"), "l")))
    pools = pooled.groupBy("grp1").agg(F.sum("n").alias("n1")).withColumn("grp2", F.when(F.col("n1") >= min_rows, F.col("grp1")).otherwise(F.lit("all")))
    last = pools.groupBy("grp2").agg(F.sum("n1").alias("n2"))
    names = pooled.join(pools, "grp1").join(last, "grp2").select("grp0", F.when(F.col("n2") >= min_rows, F.col("grp2")).alias("grp"))
    names = work.saved(names, "quality-groups")
    work.discard(counts)
    return stats.withColumn("grp0", key).join(F.broadcast(names) if names.count() <= 100_000 else names, "grp0", "left").drop("grp0")


def _distance() -> F.Column:
    diff = [F.col(f) - F.col(f"m{j}") for j, f in enumerate(FEATURES)]
    terms = [(1 if i == j else 2) * F.col(f"q{i}_{j}") * diff[i] * diff[j] for i in range(P) for j in range(i, P)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


_ESTIMATE = ", ".join(["grp string", "start int", "logdet double", *(f"m{j} double" for j in range(P)), *(f"q{i}_{j} double" for i in range(P) for j in range(i, P))])
_CENTRE = [c.split()[0] for c in _ESTIMATE.split(", ")]


def _estimates(rows: DataFrame, size: int) -> DataFrame:
    """Centre, inverse covariance and log determinant of the covariance of rows, a group and start; of about `size` rows."""
    aggs = [F.avg(f).alias(f"a{j}") for j, f in enumerate(FEATURES)]
    aggs += [F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"c{i}_{j}") for i in range(P) for j in range(i, P)]

    def invert(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                mean = np.array([r[f"a{j}"] for j in range(P)])
                cov = np.zeros((P, P))
                for i in range(P):
                    for j in range(i, P):
                        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] - mean[i] * mean[j]
                cov += np.diag(np.square(FLOOR))
                q = np.linalg.inv(cov)
                out.append([r["grp"], r["start"], np.linalg.slogdet(cov)[1], *mean, *(q[i, j] for i in range(P) for j in range(i, P))])
            yield pd.DataFrame(out, columns=_CENTRE)

    return work.packed(rows.groupBy("grp", "start").agg(*aggs), size).mapInPandas(invert, _ESTIMATE)


def _beside(rows: DataFrame, table: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """rows with the columns of a table of one row a key; few: the table was counted and is small enough to send."""
    return rows.join(F.broadcast(table) if few else table, keys)


def determinants(used: DataFrame, *, h: float, starts: tuple[float, ...] = (1.0, 0.5), max_steps: int = 50, tolerance: float = 1e-3, accuracy: int = 10_000, most_sent: int = 10_000) -> tuple[DataFrame, bool]:
    """The minimum covariance determinant estimate of each group of used(grp, features): a saved table (grp, m.., q..), and
    whether it has at most `most_sent` rows (some 3 MB), so that it may be broadcast.

    Concentration steps take the h nearest of a group's rows. They run side by side from several starts: all from medians
    and their deviations, the k-th taking the share starts[k] of h rows in its first step. Each goes on until its
    determinant falls by less than `tolerance` (in logarithm); the start of the least determinant wins. A step is two passes over
    the vectors, with partial sums before the shuffle, so a group's size doesn't matter, and as many tasks after it as the
    rows call for: a step's tables are small, and there are many steps. Raises if a group hasn't settled after `max_steps`.
    """
    size = used.count()
    median = used.groupBy("grp").agg(*(F.percentile_approx(f, 0.5, accuracy).alias(f"m{j}") for j, f in enumerate(FEATURES)))
    median = work.saved(work.packed(median, size), "quality-median")
    few = median.count() * len(starts) <= most_sent
    off = _beside(used, median, ["grp"], few).groupBy("grp").agg(*(F.first(f"m{j}").alias(f"m{j}") for j in range(P)), *(F.percentile_approx(F.abs(F.col(f) - F.col(f"m{j}")), 0.5, accuracy).alias(f"d{j}") for j, f in enumerate(FEATURES)))
    scale = lambda j: 1 / (F.pow(1.4826 * F.col(f"d{j}"), 2) + FLOOR[j] ** 2)
    first = off.select("grp", F.explode(F.array(*(F.lit(k) for k in range(len(starts))))).alias("start"), *(f"m{j}" for j in range(P)), *((scale(i) if i == j else F.lit(0.0)).alias(f"q{i}_{j}") for i in range(P) for j in range(i, P)), F.lit(float("inf")).alias("logdet"), F.lit(True).alias("going"))
    params, settled = work.saved(work.packed(first, size), "quality-params"), []
    size *= len(starts)
    for step in range(max_steps):
        live = params.where("going")
        near = _beside(used, live.drop("going", "logdet"), ["grp"], few).select("grp", "start", *FEATURES, _distance().alias("d"))
        shares = F.array(*(F.lit(h * x) for x in starts)) if step == 0 else F.array(F.lit(h))
        cut = near.groupBy("grp", "start").agg(F.element_at(F.percentile_approx("d", shares, accuracy), F.col("start") + 1 if step == 0 else F.lit(1)).alias("cut"))
        cut = work.saved(work.packed(cut, size), "quality-cut")
        new = _estimates(_beside(near, cut, ["grp", "start"], few).where("d <= cut"), size)
        # the first step may take fewer rows than the others, so its determinant is no measure
        going = F.lit(True) if step == 0 else F.col("old") - F.col("logdet") > tolerance
        old = live.select("grp", "start", F.lit(float("inf")).alias("old") if step <= 1 else F.col("logdet").alias("old"))
        before, params = params, work.saved(_beside(new, old, ["grp", "start"], few).withColumn("going", going).drop("old"), "quality-params")
        settled.append(params.where("not going"))
        work.discard(cut, *([before] if step == 0 else []))
        if params.where("going").isEmpty():
            break
    else:
        raise RuntimeError(f"a covariance estimate did not settle within {max_steps} steps")
    every = settled[0]
    for x in settled[1:]:
        every = every.unionByName(x)
    best = every.groupBy("grp").agg(F.min_by(F.struct(*_CENTRE[3:]), F.struct("logdet", "start")).alias("b"))
    return work.saved(work.packed(best.select("grp", "b.*"), size), "quality-final"), few


def verdicts(stats: DataFrame, *, min_words: int = 20, max_repeat: int = 30, min_rows: int = 60, h: float = 0.5, cutoff: float = 45.0, full_words: int = 100) -> DataFrame:
    """stats with base_failed, distance (squared Mahalanobis; null without an estimate) and kept.

    Rows that fail the base rule don't enter the estimates. A text of fewer than `full_words` words has features of
    larger sampling variance, so its distance counts in proportion to its words. `cutoff` is beyond the 0.99999 quantile
    of chi-square with seven degrees of freedom: whole documents are lost only where something is clearly off.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    stats = work.saved(stats.withColumn("base_failed", failed), "quality-measured")  # texts are measured once
    rows = work.saved(_grouped(stats, min_rows), "quality-stats")
    used = rows.where("not base_failed and grp is not null").select("grp", *FEATURES)
    params, few = determinants(used, h=h)
    # Consistency: the h-subset understates the spread, so distances are scaled to the chi-square median per group.
    level = _beside(used, params, ["grp"], few).select("grp", _distance().alias("d")).groupBy("grp").agg(F.percentile_approx("d", 0.5, 10_000).alias("mid"))
    level = work.packed(level, rows.count())
    both = work.saved(_beside(params, level, ["grp"], few), "quality-level")
    judged = rows.join(F.broadcast(both) if few else both, "grp", "left")
    weight = F.least(F.lit(1.0), F.col("n_words") / F.lit(float(full_words)))
    distance = _distance() / F.greatest(F.lit(1.0), F.col("mid") / F.lit(CHI2_MEDIAN)) * weight
    judged = judged.withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    out = judged.withColumn("kept", kept).select("doc_id", "lang", "source", "text_hash", *COUNTS, "base_failed", "distance", "kept")
    work.discard(stats, params)
    out._made = (rows, both)  # the saved tables that the result reads
    return out


def op8(documents: DataFrame) -> DataFrame:
    found = verdicts(statistics(documents))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def keep(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """documents without those rejected; columns as given. Each row goes by its own verdict, whatever other rows share its
    id: rows are told apart by id, text, language and source, which are all a verdict rests on."""
    found = verdicts(statistics(documents, id_col, text_col, lang_col, source_col))
    gone = found.where("not kept").select("doc_id", "text_hash", "lang", "source").distinct()
    gone = work.saved(work.packed(gone, found._made[0].count()), "quality-gone")
    work.discard(*found._made)  # the result rests on `gone` alone
    keys = [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), F.col(lang_col).cast("string"), F.col(source_col).cast("string")]
    return bits.without(documents, keys, gone)
