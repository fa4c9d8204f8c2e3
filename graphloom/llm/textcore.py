"""Vectorised text primitives on Arrow string batches: words, hashes, segments. No per-word Python.

Words are runs of bytes other than space and U+0009..U+000D; lower-casing touches A-Z only, so both work on UTF-8
bytes. Word hashes are 64-bit: sum T[byte] * R^i (mod 2^64) over the word, then a finaliser; with random odd R and
random T two given words collide with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_T = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_R = U64(0x9E3779B97F4A7C15)
_RINV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (finaliser of the murmur family)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[kind] = have
    return have[:n]


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of n+1) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and len(arr) else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, text: int | str, most: int = 1 << 19):
    """Cuts a batch into runs of rows of about `most` bytes of text (one row at least), so work arrays stay in cache."""
    col = batch.column(text)
    n, a = batch.num_rows, 0
    if n == 0:
        return
    _, off = text_bytes(col)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


class Words:
    """Words of a batch: byte start and end of each in `data`; words of document d are first[d]:first[d+1]."""

    def __init__(self, arr: pa.Array, lower: bool = False):
        data, self.off = text_bytes(arr)
        self.data = _LOWER[data] if lower else data
        n = len(data)
        word = ~_SEP[data]
        start = word.copy()
        start[1:] &= ~word[:-1]
        bounds = self.off[:-1]
        bounds = bounds[bounds < n]
        start[bounds] = word[bounds]
        end = word.copy()
        end[:-1] &= ~word[1:]
        last = self.off[1:] - 1
        last = last[last >= 0]
        end[last] = word[last]
        self.word = word
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.off)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def dictionary(self) -> tuple[np.ndarray, pa.Array]:
        """(code of each word, distinct words as a binary array), codes in order of first appearance."""
        body = self.data[self.word]
        off = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.end - self.start, out=off[1:])
        arr = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(body))])
        enc = arr.dictionary_encode()
        return enc.indices.to_numpy(zero_copy_only=False), enc.dictionary


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans start:end of data; equal bytes give equal hashes in every batch and process."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    if n:
        np.cumsum(_T[data] * _powers("r", _R, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers("i", _RINV, n + 1)[start] + (end - start).astype(np.uint64))


def sorted_unique(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def shingle_sets(w: Words, width: int = 2) -> list[np.ndarray]:
    """For each document its distinct `width`-word shingle hashes, sorted; with fewer words the whole sequence is one."""
    h = w.hashes()
    g = np.zeros(0, np.uint64)
    if len(h) >= width:
        g = h[: len(h) - width + 1].copy()
        for j in range(1, width):
            g = mix(g * U64(0x9FB21C651E98DF25) + h[j : len(h) - width + 1 + j])
    first, out = w.first, []
    empty = np.zeros(0, np.uint64)
    for d in range(len(first) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            out.append(sorted_unique(g[a : b - width + 1]))
        elif b > a:
            s = U64(b - a)
            for x in h[a:b]:
                with np.errstate(over="ignore"):
                    s = mix(np.array([s * U64(0xD6E8FEB86659FD93) + x + U64(1)]))[0]
            out.append(np.array([s], np.uint64))
        else:
            out.append(empty)
    return out


def crc_mod(ids: pa.Array, m: int) -> np.ndarray:
    """crc32(id as text) mod m; -1 for a null id."""
    import zlib

    return np.array([-1 if v is None else zlib.crc32(str(v).encode()) % m for v in ids.to_pylist()], np.int64)
