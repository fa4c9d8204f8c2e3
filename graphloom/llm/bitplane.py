"""Token-ID / binary output: bit-plane shuffled, zstandard-compressed id blocks with a chunk index (operator 10).

File format (little-endian), one file a shard:

    magic "GLBP1\\0\\0\\0"
    chunk payloads, one after the other: for each of the chunk's planes, a zstandard frame
    doc table: zstandard frame of n_docs int64 doc ids (0 where null), n_docs uint8 null flags, n_docs uint64 token counts
    chunk index: per chunk uint64 first id's number in the shard, uint64 file offset, uint32 ids, uint32 planes,
        uint32 crc32 of the ids, then one uint32 length a plane (MAX_PLANES of them, 0 = plane of zeros, not stored)
    footer: uint64 doc table offset, uint64 its length, uint64 index offset, uint64 chunks, uint64 docs, uint64 ids,
        uint32 bits a plane element (1 or 8), uint32 format version, magic

A chunk holds `block` ids (the last one fewer). Its ids are transposed: plane p holds bit p of every id (bit planes,
packed eight ids a byte) or byte p of every id (byte planes). High planes are nearly constant, so they compress well.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore, work

MAGIC = b"GLBP1\0\0\0"
MAX_PLANES = 32
_FOOT = struct.Struct("<6QII8s")
_ENTRY = np.dtype([("first", "<u8"), ("at", "<u8"), ("n", "<u4"), ("planes", "<u4"), ("crc", "<u4"), ("size", "<u4", MAX_PLANES)])


def split_planes(ids: np.ndarray, bits: int = 1) -> list[bytes]:
    """Planes of a block of uint32 ids, least significant first; trailing planes of zeros are left out."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    if bits == 8:
        cols = ids.view(np.uint8).reshape(-1, 4)
        return [cols[:, p].tobytes() for p in range((top + 7) // 8)]
    rows = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :top]
    packed = np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little")
    return [packed[p].tobytes() for p in range(top)]


def join_planes(planes: list[bytes], n: int, bits: int = 1) -> np.ndarray:
    if bits == 8:
        cols = np.zeros((n, 4), np.uint8)
        for p, b in enumerate(planes):
            if b:
                cols[:, p] = np.frombuffer(b, np.uint8)
        return cols.reshape(-1).view("<u4").copy()
    size = 8 * (-(-len(planes) // 8))
    rows = np.zeros((size, n), np.uint8)
    for p, b in enumerate(planes):
        if b:
            rows[p] = np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little", count=n)
    out = np.zeros((n, 4), np.uint8)
    for k in range(size // 8):  # eight planes make one byte of each id
        byte = rows[8 * k].copy()
        for j in range(1, 8):
            byte |= rows[8 * k + j] << np.uint8(j)
        out[:, k] = byte
    return out.reshape(-1).view("<u4")


class ShardWriter:
    """Writes one shard to an open binary file; memory: one block of ids and the doc table."""

    def __init__(self, f, block: int = 65536, bits: int = 1, level: int = 3):
        self.f, self.block, self.bits, self.level = f, block, bits, level
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.wait: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.at = self._write(MAGIC)
        self.index: list[tuple] = []
        self.doc_ids: list[np.ndarray] = []
        self.doc_null: list[np.ndarray] = []
        self.doc_n: list[np.ndarray] = []

    def _write(self, b: bytes) -> int:
        self.f.write(b)
        return len(b)

    def add(self, doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Appends whole documents: their ids laid end to end."""
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.doc_null.append(null.astype(np.uint8))
        self.doc_n.append(counts.astype("<u8"))
        self.wait.append(ids.astype("<u4"))
        self.waiting += len(ids)
        if self.waiting >= self.block:
            flat = np.concatenate(self.wait)
            whole = len(flat) // self.block * self.block
            for a in range(0, whole, self.block):
                self._chunk(flat[a : a + self.block])
            self.wait, self.waiting = [flat[whole:]], len(flat) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = split_planes(ids, self.bits)
        frames = [self.zstd.compress(p) if any(p) else b"" for p in planes]
        size = np.zeros(MAX_PLANES, np.uint32)
        size[: len(frames)] = [len(x) for x in frames]
        self.index.append((self.ids, self.at, len(ids), len(frames), zlib.crc32(ids.tobytes()), size))
        self.at += self._write(b"".join(frames))
        self.ids += len(ids)

    def close(self) -> tuple[int, int]:
        if self.waiting:
            self._chunk(np.concatenate(self.wait))
        cat = lambda parts, kind: np.concatenate(parts).tobytes() if parts else np.zeros(0, kind).tobytes()
        docs = sum(map(len, self.doc_ids))
        body = self.zstd.compress(cat(self.doc_ids, "<i8") + cat(self.doc_null, np.uint8) + cat(self.doc_n, "<u8"))
        table_at = self.at
        self.at += self._write(body)
        index_at = self.at
        self._write(np.array(self.index, _ENTRY).tobytes())
        self._write(_FOOT.pack(table_at, len(body), index_at, len(self.index), docs, self.ids, self.bits, 1, MAGIC))
        return docs, self.ids


class ShardReader:
    """Random access to one shard: `ids(a, b)` decodes only the chunks that hold ids a..b."""

    def __init__(self, f):
        self.f = f
        f.seek(0, io.SEEK_END)
        end = f.tell()
        f.seek(end - _FOOT.size)
        at, size, index_at, chunks, self.docs, self.n_ids, self.bits, _, magic = _FOOT.unpack(f.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a bit-plane shard")
        self.zstd = zstandard.ZstdDecompressor()
        f.seek(index_at)
        self.index = np.frombuffer(f.read(chunks * _ENTRY.itemsize), _ENTRY)
        f.seek(at)
        body = self.zstd.decompress(f.read(size))
        d = self.docs
        self.doc_ids = np.frombuffer(body, "<i8", d)
        self.doc_null = np.frombuffer(body, np.uint8, d, 8 * d).astype(bool)
        self.doc_n = np.frombuffer(body, "<u8", d, 9 * d).astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        e = self.index[k]
        self.f.seek(int(e["at"]))
        planes = []
        for p in range(int(e["planes"])):
            size = int(e["size"][p])
            planes.append(self.zstd.decompress(self.f.read(size)) if size else b"")
        ids = join_planes(planes, int(e["n"]), self.bits)
        if zlib.crc32(ids.tobytes()) != int(e["crc"]):
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, "<u4")
        k = int(np.searchsorted(self.index["first"], a, "right")) - 1
        parts = []
        while k < len(self.index) and int(self.index[k]["first"]) < b:
            first = int(self.index[k]["first"])
            parts.append(self.chunk(k)[max(0, a - first) : b - first])
            k += 1
        return np.concatenate(parts)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, first id's number in the shard, ids) of each document, one chunk in memory besides the document."""
        at, k, held, held_at = 0, 0, np.zeros(0, "<u4"), 0
        for d in range(self.docs):
            n = int(self.doc_n[d])
            parts = [held[at - held_at : at - held_at + n]]
            got = len(parts[0])
            while got < n:
                held, held_at = self.chunk(k), int(self.index[k]["first"])
                k += 1
                parts.append(held[: n - got])
                got += len(parts[-1])
            yield (None if self.doc_null[d] else int(self.doc_ids[d])), at, np.concatenate(parts) if len(parts) > 1 else parts[0]
            at += n


_CLASS = np.full(256, 1, np.uint8)  # 1 letter (with all multi-byte characters), 2 digit, 3 other
_CLASS[:128] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_ODD = np.ones(256, bool)  # bytes of words that are left to the tokenizer whole
_ODD[0x21:0x7F] = _ODD[0x80:0xC0] = _ODD[0xC3] = False
_ODD[0x27] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


class WordEncoder:
    """Encodes whole texts with a byte-pair tokenizers file that lower-cases and never joins text across white space.

    Its pre-tokens are runs of letters, single digits and runs of other signs. Words of ASCII and of the letters
    U+00C0-U+00FF are cut into such runs here, and each distinct run is encoded once a process; other words (an
    apostrophe, other scripts, marks) are units of their own, so the tokenizer sees all that could depend on context.
    The last token of a pre-token ends in the end-of-word mark, which tells the runs of a joined text apart. Units are
    found again by 64-bit hashes of their bytes; the table of known units is emptied beyond `cache` units, so memory is
    bounded (some 40 bytes a unit). `by_word=False` encodes whole texts instead, for any other tokenizer.
    """

    def __init__(self, path: str, by_word: bool = True, cache: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.by_word, self.most = Tokenizer.from_file(path), by_word, cache
        suffix = json.loads(self.tok.to_str())["model"].get("end_of_word_suffix") or ""
        self.by_word &= bool(suffix)
        if self.by_word:
            vocab = self.tok.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, the place of each in at and n
        self.pool = np.zeros(1 << 16, np.uint16 if self.by_word and len(self.last) <= 1 << 16 else np.uint32)
        self.at, self.n = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.used = self.words = 0

    @staticmethod
    def units(w: textcore.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all words, start of each unit with the end last, number of the first unit of each document, whether
        each unit is a run cut here and not an odd word)."""
        body = w.data[w.word]
        size = w.end - w.start
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        odd = _ODD[body]
        if len(body) > 1:
            odd[1:] |= (body[:-1] == 0xC3) & ((body[1:] == 0x97) | (body[1:] == 0xB7)) | (body[:-1] == 0x3C) & (body[1:] == 0x7C)
        plain = np.ones(len(size), bool)
        plain[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = False
        plain = np.repeat(plain, size)
        body = np.where(plain, _LOW[body], body)
        kind = _CLASS[body]
        cut = np.ones(len(body), bool)
        if len(body):
            cut[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & plain[1:]
            cut[at[:-1]] = True
        starts = np.append(np.flatnonzero(cut), len(body))
        return body, starts, np.searchsorted(starts, at[w.first]), plain[starts[:-1]]

    def _append(self, hashes: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        """Enters units whose ids lie end to end in flat, n of each."""
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.words + len(n) > len(self.at):
            self.at, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n))
        self.pool[self.used : self.used + len(flat)] = flat
        self.at[self.words : self.words + len(n)] = self.used + np.cumsum(n) - n
        self.n[self.words : self.words + len(n)] = n
        order = np.argsort(hashes)
        where = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, where, hashes[order])
        self.slot = np.insert(self.slot, where, (self.words + order).astype(np.int32))
        self.used += len(flat)
        self.words += len(n)

    def _learn(self, hashes: np.ndarray, words: list[str], plain: np.ndarray) -> None:
        """Encodes new units: runs many to a text, since a call costs more than a unit does, odd words each as a text."""
        runs, alone = np.flatnonzero(plain), np.flatnonzero(~plain).tolist()
        which, ids, sizes = [], [], []
        groups = [runs[a : a + 512] for a in range(0, len(runs), 512)]
        for g, e in zip(groups, self.tok.encode_batch_fast([" ".join([words[k] for k in g.tolist()]) for g in groups], add_special_tokens=False), strict=True):
            flat = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.last[flat]) + 1
            if len(ends) == len(g):
                which.append(g)
                ids.append(flat)
                sizes.append(np.diff(ends, prepend=0))
            else:
                alone += g.tolist()
        for k, e in zip(alone, self.tok.encode_batch_fast([words[k] for k in alone], add_special_tokens=False), strict=True):
            which.append([k])
            ids.append(np.array(e.ids, np.uint32))
            sizes.append([len(e.ids)])
        self._append(hashes[np.concatenate(which)], np.concatenate(ids), np.concatenate(sizes).astype(np.int32))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end with `end` after each, ids in each text)."""
        if not self.by_word:
            enc = self.tok.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            rows = [np.array([*e.ids, end], np.uint32) for e in enc]
            return (np.concatenate(rows) if rows else np.zeros(0, np.uint32)), np.array([len(r) for r in rows], np.int64)
        w = textcore.Words(texts)
        body, starts, first, plain = self.units(w)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
        code, words = units.indices.to_numpy(), units.dictionary
        data, off = textcore.text_bytes(words.cast(pa.large_string()))
        h = textcore.span_hashes(data, off[:-1], off[1:])
        order = np.argsort(h)
        h = h[order]
        if self.words + len(h) > self.most:
            self._forget()
        place = np.searchsorted(self.known, h)
        fresh = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != h) if len(self.known) else np.arange(len(h))
        if len(fresh):
            kind = np.empty(len(h), bool)
            kind[code] = plain
            kind = kind[order]
            self._learn(h[fresh], words.take(pa.array(order[fresh])).cast(pa.large_string()).to_pylist(), kind[fresh])
            place = np.searchsorted(self.known, h)
        slot = np.zeros(len(h), np.int64)
        slot[order] = self.slot[place]
        at, n = self.at[slot][code], self.n[slot][code]
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        doc_n = total[first[1:]] - total[first[:-1]] + 1
        where = np.repeat(at - total[:-1], n)
        where += np.arange(total[-1])
        ends = np.cumsum(doc_n) - 1
        out = np.empty(int(doc_n.sum()), np.uint32)
        body = np.ones(len(out), bool)
        body[ends] = False
        out[ends] = end
        out[body] = self.pool[where]
        return out, doc_n


def _filesystem(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url else url.replace("file:", "file://", 1) if url.startswith("file:") else f"file://{url}")


def write_shards(docs: DataFrame, out: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = 65536, bits: int = 1, level: int = 3, partitions: int | None = None, by_word: bool = True) -> DataFrame:
    """Encodes docs in ascending `id_col` order into shard files under `out`, a folder all executors share.

    Returns (shard, path, n_docs, n_ids), one row a non-empty shard; shard numbers follow the order of the ids.
    Null texts count as empty, null ids come first; rows with equal ids are ordered by text, so reruns agree.
    A repeated or speculative task writes another file of its own and only the row that Spark keeps names a file, so a
    lost executor leaves at worst an unnamed file behind. Works on any file system pyarrow.fs opens (file, hdfs, s3, gs).
    """
    spark = docs.sparkSession
    work.ship(spark)
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = small.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def encode(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = writer = handle = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                filesystem, base = _filesystem(out)
                filesystem.create_dir(base, recursive=True)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}.glbp"
                handle = filesystem.open_output_stream(f"{base}/{name}")
                writer, enc = ShardWriter(handle, block, bits, level), WordEncoder(tokenizer, by_word)
            for part in textcore.slices(batch, 1):
                ids = part.column(0)
                tokens, counts = enc.encode(part.column(1), end_id)
                writer.add(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), counts, tokens)
        if writer is not None:
            n_docs, n_ids = writer.close()
            handle.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [f"{out}/{name}"], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    return work.saved(work.map_arrow(ordered, encode, "shard long, path string, n_docs long, n_ids long"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(shard, doc_id, start, n_tokens, ids binary) of every document, read back from the files; one task a shard."""
    rows, base, spark = [], 0, shards.sparkSession  # one short row a shard
    for r in shards.orderBy("shard").collect():
        rows.append((r.shard, r.path, base))
        base += r.n_ids
    placed = spark.createDataFrame(rows, "shard long, path string, base long").repartitionById(max(1, len(rows)), F.col("shard").cast("int"))

    def decode(batches):
        for batch in batches:
            for shard, path, first in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                filesystem, name = _filesystem(path)
                with filesystem.open_input_file(name) as f:
                    rows, size = [], 0
                    for doc, at, ids in ShardReader(f).documents():
                        rows.append((shard, doc, first + at, len(ids), ids.astype("<u4").tobytes()))
                        size += len(ids)
                        if size > 1_000_000:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    return work.map_arrow(placed, decode, "shard long, doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "doc_id", "start", "n_tokens", "ids"])


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned crc32 of the little-endian 32-bit ids)."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10(spark, documents: DataFrame, tokenizer: str) -> DataFrame:
    shards = write_shards(documents, work.new_dir(spark, "tokens"), tokenizer)
    return digest(read_shards(shards))
