"""MinHash near-duplicates with odd sketches, links confirmed on full shingle sets (operator 1).

1. Every text becomes a set of 64-bit shingle hashes; equal sets share a node (a 64-bit hash of the set), so any number
   of copies is one node. A node has `bands` keys of `rows` MinHash values each and an odd sketch: the parity bitmap of
   its (sample number, MinHash value) pairs, whose XOR with another's estimates their difference.
2. Nodes with a band key in common are candidates. A bucket gives a star around its smallest node, not all its pairs;
   nodes joined by stars form candidate groups, inside which every pair of true links lies.
3. Groups of up to CELL nodes are verified whole in one small task: sketches drop pairs that are clearly apart, the
   rest is compared on full sets. Larger groups first link each node to its most similar star centres; then only the
   nodes outside the group's largest component are compared with all others, in cells of CELL x CELL nodes. So hot
   groups cost about their size times their stragglers, memory is bounded by a cell, and no link is lost.
4. Components of the confirmed links give each document the smallest id it reaches.

The chance that a pair at the threshold shares no band is (1 - 0.8^rows)^bands, 5e-7 by default, and less for closer
pairs. 64-bit hashes stand for shingles and sets: two different sets among n meet with a chance of n^2 / 2^65.

Defined cases: null, empty and blank texts have no shingles, stay alone and are kept; a text shorter than a shingle is
one shingle as a whole; rows that share an id and a set count as copies; null ids never become a component's id unless
it has no other (then it is null, and such rows are kept); `deduplicated` tells rows apart by id and text, so one row of a
group stays whatever ids its rows share or lack; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bits, graph, textcore, work

CELL = 256
CELL_SHINGLES = 1 << 20  # of all sets of a cell together, unless one set alone has more
SETS = 2_000  # whole sets a task calls for at least, of counted ones
SKETCH_BITS = 1024
_U32 = np.uint32


class Hasher:
    """MinHash samples, band keys and odd sketches of shingle sets."""

    def __init__(self, bands: int = 48, rows: int = 6, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.a = (rng.integers(0, 2**31, self.k, dtype=np.uint32) * _U32(2) + _U32(1))[:, None]
        self.b = rng.integers(0, 2**32, self.k, dtype=np.uint32)[:, None]
        self.fold = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = textcore.mix(np.arange(1, bands + 1, dtype=np.uint64))
        self.sample = textcore.mix(np.arange(1000, 1000 + self.k, dtype=np.uint64))

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        """The k MinHash values of a set, 512 shingles at a time."""
        v = (shingles >> np.uint64(32)).astype(np.uint32)
        least = None
        for i in range(0, len(v), 512):
            m = (self.a * v[None, i : i + 512] + self.b).min(axis=1)
            least = m if least is None else np.minimum(least, m)
        return least

    def keys(self, samples: np.ndarray) -> np.ndarray:
        m = samples.reshape(self.bands, self.rows).astype(np.uint64)
        return textcore.mix((m * self.fold).sum(axis=1, dtype=np.uint64) ^ self.band).view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        at = (textcore.mix(samples.astype(np.uint64) ^ self.sample) % np.uint64(SKETCH_BITS)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8))


def similarity(differing_bits: np.ndarray, k: int) -> np.ndarray:
    """Jaccard estimate from the population count of two odd sketches' XOR."""
    z = np.minimum(2.0 * differing_bits / SKETCH_BITS, 0.999)
    return 1 + SKETCH_BITS * np.log1p(-z) / (4 * k)


def node_of(shingles: np.ndarray) -> int:
    """64-bit name of a set (order-free: its sorted hashes are folded)."""
    with np.errstate(over="ignore"):
        x = (textcore.mix(shingles + np.uint64(0x51ED270B)) * np.arange(1, 2 * len(shingles), 2, dtype=np.uint64)).sum(dtype=np.uint64)
        return int(textcore.mix(np.array([x ^ np.uint64(len(shingles))]))[0].view(np.int64))


def signatures(docs: DataFrame, hasher: Hasher, width: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, keys) of docs(doc_id, text_hash, text); node null and no keys without shingles."""

    def sign(batches):
        for batch in batches:
            for part in textcore.slices(batch, 2):
                n, node, keys = [], [], []
                for s in textcore.shingle_sets(textcore.Words(part.column(2), lower=True), width):
                    n.append(len(s))
                    node.append(node_of(s) if len(s) else None)
                    keys.append(hasher.keys(hasher.samples(s)) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), _lists(keys)], ["doc_id", "text_hash", "n_shingles", "node", "keys"])

    return work.map_arrow(docs, sign, "doc_id long, text_hash long, n_shingles long, node long, keys array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=off[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def _sets_of(docs: DataFrame, wanted: DataFrame, hasher: Hasher, width: int) -> DataFrame:
    """wanted(node, doc, comp, large) with sketch and shingles of each node, read from the text of one document each.

    Rows that repeat both id and text give their node once a task, and once in all where any such rows are left. A bit table of at most 2 MB, made from the wanted ids, spares most other rows the work; what it lets through by
    chance the join drops, so its fixed size costs time at most.
    """
    spark = docs.sparkSession
    size = 1 << min(24, max(16, (16 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    words = wanted.where("doc is not null").select(place(F.col("doc")).alias("h")).select(F.expr("h div 64").alias("w"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("b"))
    table = np.zeros(size // 64, np.int64)
    for w, b in words.groupBy("w").agg(F.bit_or("b")).collect():  # at most size / 64 rows
        table[w] = b
    sent = spark.sparkContext.broadcast(table)

    def read(batches):
        table, given = sent.value, set()
        for batch in batches:
            h = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (table[h >> 6] >> (h & 63)) & 1 == 1
            hit |= batch.column(0).is_null().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(hit))
            for part in textcore.slices(batch, 1):
                ids, node, sketch, sets = [], [], [], []
                for d, s in zip(part.column(0).to_pylist(), textcore.shingle_sets(textcore.Words(part.column(1), lower=True), width), strict=True):
                    if not len(s) or (d, name := node_of(s)) in given:
                        continue
                    given.add((d, name))
                    ids.append(d)
                    node.append(name)
                    sketch.append(hasher.sketch(hasher.samples(s)).tobytes())
                    sets.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), _lists(sets)], ["d", "node", "sketch", "shingles"])

    found = docs.select("doc_id", "text", place(F.col("doc_id")).alias("h"))
    found = work.map_arrow(found, read, "d long, node long, sketch binary, shingles array<long>")
    keep = wanted.select(F.col("node").alias("node0"), "doc", "comp", "large")
    sets = work.saved(found.join(keep, (F.col("node") == F.col("node0")) & F.col("d").eqNullSafe(F.col("doc"))).select("node", "comp", "large", "sketch", "shingles"), "dup-sets")
    if sets.count() > wanted.count():
        once = work.saved(sets.dropDuplicates(["node"]), "dup-sets")
        work.discard(sets)
        return once
    return sets


def _shared_keys(named: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, key) of keys that lie in a bucket of several nodes, and of few others that the bit table lets through: keys
    that no other node has, nearly all, stay out of the join."""
    table = bits.bit_table(buckets.select(F.col("key0").alias("key")))
    sent = named.sparkSession.sparkContext.broadcast(table)
    size = int(len(table)).bit_length() + 2

    def keep(batches):
        table = sent.value
        for batch in batches:
            h = batch.column(2).to_numpy()
            hit = table[h >> 3] >> (7 - (h & 7)).astype(np.uint8) & 1 == 1
            yield batch.filter(pa.array(hit)).select([0, 1])

    keys = named.select("node", F.explode("keys").alias("key"))
    return keys.withColumn("h", F.shiftrightunsigned(F.xxhash64("key"), 64 - size)).transform(lambda d: work.map_arrow(d, keep, "node long, key long"))


class Cell:
    """Exact comparison of up to CELL nodes with up to CELL others."""

    def __init__(self, hasher: Hasher, percent: int, slack: float):
        self.k, self.percent, self.least = hasher.k, percent, percent / 100 - slack

    def links(self, qs: list[np.ndarray], qk: np.ndarray, ss: list[np.ndarray], sk: np.ndarray) -> np.ndarray:
        """Matrix of confirmed links between the sets qs and ss; qk, sk are their sketches as uint64 rows."""
        nq, ns = np.array([len(x) for x in qs]), np.array([len(x) for x in ss])
        out = np.zeros((len(qs), len(ss)), bool)
        far = np.zeros((len(qs), len(ss)), np.int64)
        for w in range(qk.shape[1]):
            far += np.bitwise_count(qk[:, w][:, None] ^ sk[:, w][None, :])
        near = similarity(far, self.k) >= self.least
        near &= 100 * np.minimum(nq[:, None], ns[None, :]) >= self.percent * np.maximum(nq[:, None], ns[None, :])
        cols = np.flatnonzero(near.any(axis=0))
        if not len(cols):
            return out
        flat = np.concatenate([ss[c] for c in cols])
        owner = np.repeat(np.arange(len(cols)), ns[cols])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for q in np.flatnonzero(near.any(axis=1)):
            lo, hi = np.searchsorted(flat, qs[q], "left"), np.searchsorted(flat, qs[q], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(cols))
            out[q, cols] = 100 * both >= self.percent * (nq[q] + ns[cols] - both)
        return out & near


def _unpack(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct nodes, their sketches as uint64 rows, their sets."""
    seen = {r[0]: r for r in rows}
    nodes = np.array(list(seen), np.int64)
    sketches = np.array([np.frombuffer(r[1], np.uint64) for r in seen.values()])
    return nodes, sketches, [np.asarray(r[2]).view(np.uint64) for r in seen.values()]


def _groups(batches, key: int):
    """Runs of rows with equal values in the first `key` columns of sorted batches, as lists of tuples."""
    current, rows = None, []
    for batch in batches:
        cols = [batch.column(c) for c in range(batch.num_columns)]
        plain = [c.to_numpy(zero_copy_only=False) for c in cols]
        for r in zip(*plain, strict=True):
            if r[:key] != current:
                if rows:
                    yield current, rows
                current, rows = r[:key], []
            rows.append(r[key:])
    if rows:
        yield current, rows


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _verify_small(members: DataFrame, cell: Cell, count: int) -> DataFrame:
    """Confirmed links of whole groups (comp, node, sketch, shingles) of CELL nodes at most, `count` in all: a star a component."""

    def run(batches):
        for _, rows in _groups(batches, 1):
            nodes, sketches, sets = _unpack(rows)
            if len(nodes) < 2:
                continue
            linked = cell.links(sets, sketches, sets, sketches)
            label = np.arange(len(nodes))
            while True:
                new = np.where(linked, label[None, :], len(nodes)).min(axis=1)
                new = np.minimum(new, label)
                if (new == label).all():
                    break
                label = new
            if pairs := [(int(nodes[label[i]]), int(nodes[i])) for i in range(len(nodes)) if label[i] != i]:
                yield _edges(pairs)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.packed(members.select("comp", "node", "sketch", "shingles").repartition(n, "comp"), count, SETS)
    return dealt.sortWithinPartitions("comp").transform(lambda d: work.map_arrow(d, run, "a long, b long"))


def _verify_pairs(pairs: DataFrame, sets: DataFrame, cell: Cell, count: int, many: int, best: int = 3) -> DataFrame:
    """Links of each node b with the `best` most similar (by sketch) of its star centres a; pairs(a, b), `many` at most, of
    `count` sets."""
    k, least = cell.k, cell.least
    light = sets.select("node", "sketch")
    both = work.packed(pairs.join(light.select(F.col("node").alias("a"), F.col("sketch").alias("ka")), "a"), many)
    both = work.packed(both.join(light.select(F.col("node").alias("b"), F.col("sketch").alias("kb")), "b"), many)

    def estimate(batches):
        for batch in batches:
            x = np.array([np.frombuffer(v, np.uint64) for v in batch.column("ka").to_pylist()]).reshape(batch.num_rows, -1)
            y = np.array([np.frombuffer(v, np.uint64) for v in batch.column("kb").to_pylist()]).reshape(batch.num_rows, -1)
            est = similarity(np.bitwise_count(x ^ y).sum(axis=1), k)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], ["a", "b", "est"])

    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("est"), "a"))  # a node has one centre a band at most
    top = work.map_arrow(both, estimate, "a long, b long, est double").where(F.col("est") >= least).withColumn("rank", rank).where(F.col("rank") <= best)
    top = work.packed(top, many)
    full = sets.select("node", "shingles")
    rows = work.packed(top.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a"), best * count, SETS)
    rows = work.packed(rows.join(full.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"), best * count, SETS)

    def exact(batches):
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "sa", "sb")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= cell.percent * (len(x) + len(y) - both):
                    found.append((a, b))
            if found:
                yield _edges(found)

    return work.map_arrow(rows.select("a", "b", "sa", "sb"), exact, "a long, b long")


def _verify_grid(members: DataFrame, cell: Cell, count: int) -> DataFrame:
    """Links between stragglers and all nodes of large groups: members(comp, node, sketch, shingles, label, straggler), `count` in all.

    Cells of about CELL x CELL nodes, of fewer where sets are long; each straggler reports one partner for every component it links to in a cell.
    """
    blocks = lambda rows, shingles: F.ceil(F.greatest(F.col(rows) / CELL, F.col(shingles) / CELL_SHINGLES)).cast("long")
    late, long = F.col("straggler").cast("long"), F.size("shingles").cast("long")
    size = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum(long).alias("mw"), F.sum(late).alias("s"), F.sum(late * long).alias("sw")).where("s > 0")
    size = work.packed(size.select(F.col("comp").alias("comp0"), blocks("m", "mw").alias("mb"), blocks("s", "sw").alias("sb")), count)
    placed = work.packed(members.join(size, F.col("comp") == F.col("comp0")), count, SETS).withColumn("h", F.xxhash64("node"))
    cols = ["comp", "x", "y", "node", "sketch", "shingles", "label", "side"]
    queries = placed.where("straggler").withColumn("x", F.pmod("h", "sb")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1))).withColumn("side", F.lit(True)).select(cols)
    others = placed.withColumn("y", F.pmod("h", "mb")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sb") - 1))).withColumn("side", F.lit(False)).select(cols)

    def run(batches):
        for _, rows in _groups(batches, 3):
            labels = {r[0]: r[3] for r in rows}
            qs, qk, qsets = _unpack([r for r in rows if r[4]])
            ss, sk, ssets = _unpack([r for r in rows if not r[4]])
            pairs = []
            for at in range(0, len(qs), CELL):
                for bt in range(0, len(ss), CELL):
                    linked = cell.links(qsets[at : at + CELL], qk[at : at + CELL], ssets[bt : bt + CELL], sk[bt : bt + CELL])
                    for i in range(len(linked)):
                        q, seen = int(qs[at + i]), set()
                        for j in np.flatnonzero(linked[i]):
                            s = int(ss[bt + j])
                            if labels[s] != labels[q] and labels[s] not in seen:
                                seen.add(labels[s])
                                pairs.append((q, s))
            if pairs:
                yield _edges(pairs)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = queries.unionByName(others).repartition(n, "comp", "x", "y").sortWithinPartitions("comp", "x", "y")
    return work.map_arrow(cells, run, "a long, b long")


def _placed(documents: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 48, rows: int = 6, slack: float = 0.13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, node, keys) of every row; (node4, comp, component): the group of each node and the
    smallest id in it; the saved table of that."""
    spark = documents.sparkSession
    work.ship(spark)
    hasher = Hasher(bands, rows)
    cell = Cell(hasher, percent, slack)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    sig = work.saved(signatures(docs, hasher, width), "dup-sig")
    named = sig.where("node is not null").select("doc_id", "n_shingles", "node", "keys")
    keys = named.select("node", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a <> top").select(F.col("key").alias("key0"), "a")
    buckets = work.saved(buckets, "dup-buckets")
    stars = _shared_keys(named, buckets).join(buckets, F.col("key") == F.col("key0")).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    stars = work.saved(stars, "dup-stars")
    work.discard(buckets)
    n = sig.count()
    least = named.groupBy("node").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"))
    least = work.saved(work.packed(least, n), "dup-least")
    groups = graph.components(stars, "dup-groups")
    members = work.saved(work.packed(groups.join(least, "node").select("node", "doc", "n", "comp"), n), "dup-members")
    work.discard(groups)
    members = work.alone(members, members.count())
    size = members.groupBy("comp").agg(((F.count(F.lit(1)) > CELL) | (F.sum("n") > CELL_SHINGLES)).alias("large")).select(F.col("comp").alias("comp0"), "large")
    wanted = work.saved(members.join(size, F.col("comp") == F.col("comp0")).select("node", "doc", "comp", "large"), "dup-wanted")
    work.discard(members)
    sets = _sets_of(docs, wanted, hasher, width)
    links = work.saved(_verify_small(sets.where("not large"), cell, sets.where("not large").count()), "dup-links")
    large = wanted.where("large").select("node")
    if count := large.count():
        inside = stars.join(large.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
        big_sets = sets.where("large").select("node", "comp", "sketch", "shingles")
        first = work.saved(_verify_pairs(inside, big_sets, cell, count, stars.count()), "dup-links")
        labels = graph.components(first, "dup-first")
        labelled = big_sets.join(labels.select(F.col("node").alias("node1"), F.col("comp").alias("label1")), F.col("node") == F.col("node1"), "left")
        labelled = work.packed(labelled, count, SETS).withColumn("label", F.coalesce("label1", "node"))
        counts = work.packed(labelled.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n")), count)
        main = counts.groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("main")).select(F.col("comp").alias("comp2"), "main")
        main = work.packed(main, count)
        marked = labelled.join(main, F.col("comp") == F.col("comp2")).select("comp", "node", "sketch", "shingles", "label", (F.col("label") != F.col("main")).alias("straggler"))
        marked = work.saved(work.packed(marked, count, SETS), "dup-marked")
        links = work.saved(links.unionByName(first).unionByName(_verify_grid(marked, cell, count)), "dup-links")
        work.discard(marked, labels)
    work.discard(sets, stars, wanted)
    linked = graph.components(links, "dup-linked").select(F.col("node").alias("node1"), F.col("comp").alias("comp1"))
    owner = least.join(linked, F.col("node") == F.col("node1"), "left").select("node", "doc", F.coalesce("comp1", "node").alias("comp"))
    owner = work.saved(work.packed(owner, n), "dup-owner")
    owner = work.alone(owner, owner.count())
    # Most nodes are a group of their own: only the others are grouped and joined.
    several = owner.groupBy("comp").agg(F.min("doc").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("comp").alias("comp3"), "component")
    final = owner.join(several, F.col("comp") == F.col("comp3"), "left").select(F.col("node").alias("node4"), "comp", F.when(F.col("comp3").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component"))
    work.discard(least)
    return sig, final, owner


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; links: 100 * |A & B| >= percent * |A | B|."""
    sig, final, _ = _placed(documents, **options)
    out = sig.drop("keys").join(final, F.col("node") == F.col("node4"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents, width=2)


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """documents without near-duplicates: one row of each group stays; columns as given.

    The row of the smallest id stays (null ids last, then by a hash of the text); of rows that repeat both that id and its
    text, one, and so of rows without shingles that repeat both.
    """
    sig, final, owner = _placed(documents, id_col=id_col, text_col=text_col, **options)
    n = sig.count()
    rows = work.saved(work.packed(sig.join(final, F.col("node") == F.col("node4")).select("doc_id", "text_hash", "comp"), n), "dup-rows")
    rows = work.alone(rows, n)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    groups = rows.groupBy(F.col("comp").alias("comp0")).agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = work.alone(work.saved(work.packed(groups, n), "dup-best"), n)
    several = rows.join(groups, F.col("comp") == F.col("comp0"))
    gone = work.saved(work.packed(several.where(place != F.col("best")).select("doc_id", "text_hash").distinct(), n), "dup-gone")
    keys = [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))]
    out = bits.without(documents, keys, gone)
    stay = several.where(place == F.col("best")).select("doc_id", "text_hash").unionByName(sig.where("node is null").select("doc_id", "text_hash"))
    twice = stay.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("doc_id", "text_hash")
    twice = work.saved(work.packed(twice, n), "dup-twice")
    work.discard(sig, owner, rows, groups)  # the result rests on `gone` and `twice` alone
    if twice.isEmpty():
        return out
    names = [work.fresh(documents, "twice_id"), work.fresh(documents, "twice_hash")]
    twice = twice.toDF(*names)
    same = keys[0].eqNullSafe(F.col(names[0])) & keys[1].eqNullSafe(F.col(names[1]))
    once = out.join(twice, same).dropDuplicates(names).select(documents.columns)
    return bits.without(out, keys, twice).unionByName(once)
