"""Benchmark decontamination by q-gram lemma filtering in overlapping diagonal bands (operator 7).

A benchmark text of n characters that lies in a document with at most k edits shares at least n - q + 1 - k*q q-grams
with it, all on diagonals (document offset minus benchmark offset) that differ by k at most. Documents are scanned for
the benchmark's q-grams; hits are counted per text and diagonal band, where bands of width 2(k+1) overlap by half, so some
band holds all of a match's diagonals. Bands that reach the bound are regions to verify by banded alignment.

What is sought are pieces: an item of more than `whole` characters is cut into overlapping pieces of `piece` characters,
each half a piece after the one before and one at the item's end, each with an edit budget of its own, so a document that
quotes part of an item is found; a shorter item is one piece. Text is compared lower-cased (A-Z) with runs of white space
as one space, as UTF-8 bytes (all sizes and places are bytes of that); k is `edits` of a piece's length, less where the
lemma's bound would fall below one. Items shorter than `q` + 8 are sought as exact word sequences, by hashes of word runs.

Defined cases: null or empty texts and items match nothing; null item ids are reported as null; repeated items are
reported for each id; an empty benchmark leaves every document clean; rows that share or lack an id are judged each by its
own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits, textcore, work

Q = 10
PIECE, WHOLE = 200, 300
HITS = 1 << 21  # hits counted at a time
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TABLE_BITS = 22


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): lower-cased words of each text with one space between them and after each."""
    w = textcore.Words(texts, lower=True)
    size = w.end - w.start
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    body = np.flatnonzero(w.word)
    out[np.arange(len(body)) + np.repeat(np.arange(len(size)), size)] = w.data[body]
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=ends[1:])
    return out, ends[w.first]


def grams(data: np.ndarray) -> np.ndarray:
    """64-bit keys of the Q-byte windows at every position with room for one."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    words = np.ndarray((n + Q - 8,), "<u8", buffer=data, strides=(1,))
    key = words[:n] * _C1
    key ^= key >> np.uint64(29)
    key += words[Q - 8 :] * _C2
    key *= _C1
    return key


class Items:
    """The benchmark's pieces: sorted keys of their q-grams with the places that hold each, and a bit table before them."""

    def __init__(self, ids: list, texts: list, edits: float, piece: int = PIECE, whole: int = WHOLE):
        data, off = normalised(pa.array(texts, pa.string()))
        self.ids, self.size = [], []  # of items
        self.item, self.begin, self.text, self.k = [], [], [], []  # of pieces
        keys, owner, place, short = [], [], [], []
        for r in range(len(ids)):
            t = data[off[r] : max(off[r], off[r + 1] - 1)]  # without the last space
            if not len(t):
                continue
            i, n = len(self.ids), len(t)
            self.ids.append(ids[r])
            self.size.append(n)
            if n < Q + 8:
                short.append((int((t == 0x20).sum()) + 1, int(textcore.span_hashes(t, np.array([0]), np.array([n]))[0]), i, t.tobytes()))
                continue
            starts = [0] if n <= whole else [*range(0, n - piece, piece // 2), n - piece]
            for a in starts:
                part = t if n <= whole else t[a : a + piece]
                g = grams(part)
                keys.append(g)
                owner.append(np.full(len(g), len(self.item), np.int32))
                place.append(np.arange(len(g), dtype=np.int32))
                self.item.append(i)
                self.begin.append(a)
                self.text.append(part)
                self.k.append(max(0, min(int(edits * len(part)), (len(part) - Q) // Q)))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        keys = cat(keys, np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, self.owner, self.place = keys[order], cat(owner, np.int32)[order], cat(place, np.int32)[order]
        self.keys, first = np.unique(keys, return_index=True)
        self.first = np.append(first, len(keys)).astype(np.int32)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - TABLE_BITS)] = True
        self.k = np.array(self.k, np.int64)
        self.bound = np.array([len(t) for t in self.text], np.int64) - Q + 1 - self.k * Q
        # short items: words in each, hash of each, sorted by both
        self.short: dict[int, tuple[np.ndarray, list[int], list[bytes]]] = {}
        for words in sorted({x[0] for x in short}):
            rows = sorted(x[1:] for x in short if x[0] == words)
            self.short[words] = (np.array([x[0] for x in rows], np.uint64), [x[1] for x in rows], [x[2] for x in rows])

    def candidates(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, piece, least diagonal, greatest diagonal) of the bands that meet the bound."""
        none = (np.zeros(0, np.int64),) * 4
        g = grams(data)
        if not len(g) or not len(self.keys):
            return none
        at = np.flatnonzero(self.table[g >> np.uint64(64 - TABLE_BITS)])
        slot = np.searchsorted(self.keys, g[at])
        slot[slot == len(self.keys)] = 0
        right = self.keys[slot] == g[at]
        at, slot = at[right], slot[right]
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + Q <= off[doc + 1]
        at, slot, doc = at[inside], slot[inside], doc[inside]
        if not len(at):
            return none
        # A gram may have many places, so hits are spelled out and counted a bounded number at a time.
        n = (self.first[slot + 1] - self.first[slot]).astype(np.int64)
        upto = np.cumsum(n)
        parts, a = [], 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
            parts.append(self._counted(at[a:b], slot[a:b], doc[a:b], n[a:b], off))
            if len(parts) > 1 and (b == len(n) or sum(len(x[0]) for x in parts) > HITS):
                parts = [_merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
            a = b
        d, p, _, count, lo, hi = parts[0]
        good = count >= self.bound[p]
        # both grids may name the same diagonals
        rows = np.unique(np.column_stack([d[good], p[good], lo[good], hi[good]]), axis=0)
        return tuple(rows.T)

    def _counted(self, at, slot, doc, n, off) -> tuple[np.ndarray, ...]:
        """(document, piece, band, hits, least and greatest diagonal) of the hits at some positions."""
        at, doc = np.repeat(at, n), np.repeat(doc, n)
        shift = np.cumsum(n) - n
        hit = np.repeat(self.first[slot] - shift, n) + np.arange(len(at))
        piece, place = self.owner[hit].astype(np.int64), self.place[hit].astype(np.int64)
        # two grids of bands, the second shifted by half a band; diagonals counted from the document's start
        diagonal = at - off[doc] - place
        half = self.k[piece] + 1
        bands = [2 * ((diagonal + s * half) // (2 * half)) + s for s in (0, 1)]
        twice = lambda x: np.concatenate([x, x])
        return _merged(twice(doc), twice(piece), np.concatenate(bands), np.ones(2 * len(at), np.int64), twice(diagonal), twice(diagonal))

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int, int]]:
        """(row, item, length and edit budget and edits of its best piece, start, end of all that matches): each item found
        in each text, places as bytes of the normalised text."""
        data, off = normalised(texts)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}  # (row, piece): edits, start, end
        for d, p, lo, hi in zip(*(x.tolist() for x in self.candidates(data, off)), strict=True):
            if found.get((d, p), (1,))[0] == 0:
                continue
            k, piece = int(self.k[p]), self.text[p]
            n = len(piece)
            a, b = max(0, lo - k), min(int(off[d + 1] - off[d]), hi + n + k)
            text = data[off[d] + a : off[d] + b]
            exact = text.tobytes().find(piece.tobytes())
            edits, start, end = (0, exact, exact + n) if exact >= 0 else banded(piece, text, lo - k - a, hi + k - a, k)
            if edits <= k and ((d, p) not in found or found[d, p][0] > edits):
                found[d, p] = (edits, a + start, a + end)
        best: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        for (d, p), (edits, start, end) in sorted(found.items()):
            i, size, k = self.item[p], len(self.text[p]), int(self.k[p])
            old = best.get((d, i))
            first = (size, k, edits) if old is None or edits * old[0] < old[2] * size else old[:3]
            best[d, i] = (*first, min(start, old[3] if old else start), max(end, old[4] if old else end))
        for d, i, start, end in self._short(data, off):
            best.setdefault((d, i), (end - start, 0, 0, start, end))
        return [(d, i, *x) for (d, i), x in sorted(best.items())]

    def _short(self, data: np.ndarray, off: np.ndarray):
        """(row, item, start, end) of the word runs that equal a short item."""
        if not self.short or not len(data):
            return
        ends = np.flatnonzero(data == 0x20)
        starts = np.concatenate([[0], ends[:-1] + 1])
        doc = np.searchsorted(off, starts, "right") - 1
        for words, (hashes, owner, text) in self.short.items():
            if len(starts) < words:
                continue
            a, b, d = starts[: len(starts) - words + 1], ends[words - 1 :], doc[: len(starts) - words + 1]
            h = textcore.span_hashes(data, a, b)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for k in np.flatnonzero((hashes[at] == h) & (d == doc[words - 1 :])).tolist():
                j = int(at[k])
                while j < len(hashes) and hashes[j] == h[k]:
                    if data[a[k] : b[k]].tobytes() == text[j]:
                        yield int(d[k]), owner[j], int(a[k] - off[d[k]]), int(b[k] - off[d[k]])
                    j += 1


def _merged(doc, piece, band, count, lo, hi) -> tuple[np.ndarray, ...]:
    """Rows of equal document, piece and band made one: counts added, diagonals spanned."""
    order = np.lexsort((band, piece, doc))
    doc, piece, band, count, lo, hi = (x[order] for x in (doc, piece, band, count, lo, hi))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1]) | (band[1:] != band[:-1])
    at = np.flatnonzero(new)
    return doc[at], piece[at], band[at], np.add.reduceat(count, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)


def banded(item: np.ndarray, text: np.ndarray, lo: int, hi: int, k: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best place of item in text with diagonals lo..hi only; edits k+1 if there is none.

    Row j of the table holds item[:j] against text ending on each diagonal; a start anywhere in the band is free.
    """
    width = hi - lo + 1
    far = k + 1
    col0 = np.arange(lo, hi + 1)  # text offset of each diagonal at row 0
    m = len(text)
    cost = np.where((col0 >= 0) & (col0 <= m), 0, far).astype(np.int64)
    start = np.clip(col0, 0, m)
    steps = np.arange(width)
    padded = np.concatenate([np.zeros(1, np.uint8), text])
    for j in range(1, len(item) + 1):
        col = col0 + j
        ok = (col >= 1) & (col <= m)
        same = ok & (padded[np.clip(col, 0, m)] == item[j - 1])
        diagonal = np.where(ok, cost + ~same, far)
        up = np.append(cost[1:] + 1, far)  # item character against nothing
        take_up = up < diagonal
        here = np.where(take_up, up, diagonal)
        begin = np.where(take_up, np.append(start[1:], 0), start)
        # text characters against nothing: running minimum of cost - step along the row
        level = np.minimum.accumulate(here - steps)
        source = np.maximum.accumulate(np.where(here - steps == level, steps, 0))
        cost = np.minimum(np.where((col >= 0) & (col <= m), level + steps, far), far)
        start = begin[source]
        if cost.min() > k:
            return far, 0, 0
    best = int(np.argmin(cost))
    return int(cost[best]), int(start[best]), int(min(m, col0[best] + len(item)))


def matches(documents: DataFrame, benchmark: DataFrame, *, edits: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, item_bytes, piece_bytes, max_edits, edits, start, end): each item found in each document, the edit
    budget and edits of its best piece, and the span of all its pieces that match, in bytes of the normalised text.

    The benchmark is read in blocks of at most `block_bytes` of text: the documents are scanned once a block, so what is
    sent to the executors (some 30 times a block's size) has a bound however large the benchmark is.
    """
    return _scan(documents, benchmark, edits, id_col, text_col, item_col, item_text, block_bytes).drop("text_hash")


def _scan(documents, benchmark, edits, id_col, text_col, item_col, item_text, block_bytes) -> DataFrame:
    spark = documents.sparkSession
    work.ship(spark)
    text = F.col(text_col).cast("string")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    schema = "doc_id long, text_hash long, item_id long, item_bytes long, piece_bytes long, max_edits long, edits long, start long, end long"
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(ids, texts):
        sent = spark.sparkContext.broadcast(Items(ids, texts, edits))

        def run(batches):
            items = sent.value
            for batch in batches:
                for part in textcore.slices(batch, 2):
                    if rows := items.matches(part.column(2)):
                        at = pa.array([r[0] for r in rows])
                        yield pa.RecordBatch.from_arrays([
                            part.column(0).take(at),
                            part.column(1).take(at),
                            pa.array([items.ids[r[1]] for r in rows], pa.int64()),
                            pa.array([items.size[r[1]] for r in rows], pa.int64()),
                            *(pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4, 5, 6)),
                        ], names)

        return work.map_arrow(docs, run, schema)

    ids, texts, size, out = [], [], 0, None
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(item_text).cast("string")).toLocalIterator():
        text = row[1] or ""
        if size and size + len(text) > block_bytes:
            found = scan(ids, texts)
            out = found if out is None else out.unionByName(found)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(text)
        size += len(text)
    found = scan(ids, texts)
    return found if out is None else out.unionByName(found)


def op7(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(documents, benchmark)


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """documents without those that hold a benchmark item or a piece of one; columns as given. Each row goes by its own
    text, whatever other rows share its id."""
    found = _scan(documents, benchmark, **({"edits": 0.08, "id_col": id_col, "text_col": text_col, "item_col": "item_id", "item_text": "text", "block_bytes": 4 << 20} | options))
    leaked = work.saved(work.packed(found.select("doc_id", "text_hash").distinct(), documents.count()), "leaked")
    return bits.without(documents, [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))], leaked)
