"""Substring dedup by sliding sentence spans (operator 3).

Texts are cut into sentences (a word that ends in . ! or ?, closing quotes and brackets aside, ends one, and so does a
line break). A span is a run of at least `run` consecutive sentences and `least_words` words, or of any number of
sentences (one will do) with `short_words` words. The shortest span from every sentence on and the shortest one up to
every sentence are taken, so every sentence of a repeated run that is long enough lies in one of them inside the run:
if the span from it on would leave the run, the one up to the run's end begins before it. Spans are hashed on
lower-cased words, grouped globally, and every sentence that a span covers which occurred before (in a document of smaller id, or earlier in the same document) is removed.

Hot passages: a span's occurrences are only counted and minimised (partial sums before the shuffle), never gathered;
the join that marks repeats has one row on its other side a span, and adaptive execution splits its hot keys.

Defined cases: null and empty texts have no sentences; a text with too few words has no span; rows are told apart by id
and text: those that share an id follow each other by a hash of their texts, null ids come last, and rows that repeat
both id and text are one document (none removes the other); other columns are left as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore, work

_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"\"')]}")] = True
LAST = (1 << 63) - 1


def segment(w: textcore.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each sentence with the number of words last, first sentence of each document)."""
    n = len(w)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(w.off), np.int64)
    last = w.end - 1
    for _ in range(2):  # up to two closing signs after the stop
        back = _CLOSE[w.data[last]] & (last > w.start)
        last = last - back
    ends = _END[w.data[last]]
    breaks = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data == 0x0A, out=breaks[1:])
    cut = np.ones(n, bool)
    cut[1:] = ends[:-1] | (breaks[w.start[1:]] > breaks[w.end[:-1]])
    inside = w.first[w.first < n]
    cut[inside] = True
    starts = np.append(np.flatnonzero(cut), n)
    return starts, np.searchsorted(starts, w.first)


def spans(w: textcore.Words, run: int, least_words: int, short_words: int) -> tuple[np.ndarray, ...]:
    """(document, first sentence in it, sentences, hash) of every span."""
    starts, first = segment(w)
    n = len(starts) - 1
    if not n:
        return (np.zeros(0, np.int64),) * 4
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    sums = np.zeros(len(w) + 1, np.uint64)
    # a polynomial over word hashes: spans of any length compare by one subtraction and one product
    np.cumsum(textcore.mix(w.hashes()) * textcore._powers("r", textcore._R, len(w)), out=sums[1:])
    k = np.arange(n)
    after = [np.maximum(k + m, np.searchsorted(starts, starts[:-1] + words, "left")) for m, words in ((run, least_words), (1, short_words))]
    before = [np.minimum(k + 1 - m, np.searchsorted(starts, starts[1:] - words, "right") - 1) for m, words in ((run, least_words), (1, short_words))]
    end, begin = np.minimum(*after), np.maximum(*before)
    on, up = end <= first[doc + 1], begin >= first[doc]
    code = np.unique(np.concatenate([k[on] * (n + 1) + end[on], begin[up] * (n + 1) + k[up] + 1]))
    s, e = code // (n + 1), code % (n + 1)
    doc = doc[s]
    a, b = starts[s], starts[e]
    h = textcore.mix((sums[b] - sums[a]) * textcore._powers("i", textcore._RINV, len(w) + 1)[a] + (b - a).astype(np.uint64))
    return doc, s - first[doc], e - s, h.view(np.int64)


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, key, text): doc orders documents by id with null last, doc and key together tell rows apart."""
    text = F.col(text_col).cast("string")
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(id_col).isNull(), text).alias("key"), text.alias("text"))


def repeats(documents: DataFrame, *, run: int = 3, least_words: int = 20, short_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, key, first, sentences): every span occurrence that isn't the span's first."""
    work.ship(documents.sparkSession)
    docs = _keyed(documents, id_col, text_col).select("doc", "key", "text")

    def find(batches):
        for batch in batches:
            for part in textcore.slices(batch, 2):
                doc, first, size, h = spans(textcore.Words(part.column(2), lower=True), run, least_words, short_words)
                # the n-th occurrence of a span inside its own document
                order = np.lexsort((first, h, doc))
                again = np.zeros(len(h), bool)
                again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column(0).take(at), part.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(again)], ["h", "doc", "key", "first", "size", "again"])

    rows = work.saved(work.map_arrow(docs, find, "h long, doc long, key long, first int, size int, again boolean"), "span-rows")
    place = F.struct("doc", "key")
    seen = rows.groupBy("h").agg(F.min(place).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("h0"), "owner")
    later = rows.join(seen, F.col("h") == F.col("h0")).where((place > F.col("owner")) | F.col("again"))
    return later.select("doc", "key", "first", "size")


def covered(found: DataFrame) -> DataFrame:
    """(doc, key, removed): sorted numbers of the sentences that repeated spans cover, each once."""
    each = found.select("doc", "key", F.explode(F.expr("sequence(first, first + size - 1)")).alias("s")).distinct()
    return each.groupBy("doc", "key").agg(F.sort_array(F.collect_list("s")).alias("removed"))  # bounded by the document's length


def cut(documents: DataFrame, *, run: int = 3, least_words: int = 20, short_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, n_words, words_removed, kept text) of every row."""
    removed = work.saved(covered(repeats(documents, run=run, least_words=least_words, short_words=short_words, id_col=id_col, text_col=text_col)), "span-removed")
    removed = removed.toDF("doc0", "key0", "removed")
    joined = _keyed(documents, id_col, text_col).join(removed, (F.col("doc") == F.col("doc0")) & (F.col("key") == F.col("key0")), "left").select("doc_id", "text", "removed")

    def apply(batches):
        for batch in batches:
            for part in textcore.slices(batch, 1):
                w = textcore.Words(part.column(1))
                starts, first = segment(w)
                texts, gone = part.column(1).to_pylist(), part.column(2).to_pylist()
                n, out, lost, words = np.diff(first), [], [], []
                for d in range(part.num_rows):
                    drop = gone[d] or ()
                    lost.append(len(drop))
                    words.append(int(sum(starts[first[d] + s + 1] - starts[first[d] + s] for s in drop)))
                    out.append(_without(texts[d], w, starts, int(first[d]), d, drop) if drop else texts[d])
                cols = [part.column(0), pa.array(n.astype(np.int64)), pa.array(lost, pa.int64()), pa.array(w.counts().astype(np.int64)), pa.array(words, pa.int64()), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_sentences", "n_removed", "n_words", "words_removed", "text"])

    return work.map_arrow(joined, apply, "doc_id long, n_sentences long, n_removed long, n_words long, words_removed long, text string")


def _without(text: str, w: textcore.Words, starts: np.ndarray, first: int, d: int, drop: list[int]) -> str:
    """The text without the sentences in drop, each cut with the white space that follows it."""
    raw = text.encode()
    base, end = int(w.off[d]), int(w.off[d + 1])
    keep, at = [], 0
    for s in drop:
        a = int(w.start[starts[first + s]]) - base
        nxt = starts[first + s + 1]
        b = int(w.start[nxt]) - base if nxt < w.first[d + 1] else end - base
        keep.append(raw[at:a])
        at = max(at, b)
    keep.append(raw[at:])
    return b"".join(keep).decode()


def op3(documents: DataFrame) -> DataFrame:
    out = cut(documents)
    return out.select("doc_id", "n_sentences", "n_removed", "n_words", "words_removed", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("kept_crc32"))
