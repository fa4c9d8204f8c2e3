"""Merkle manifest of a dataset by supersteps over an RDD of tree nodes.

Every row is a leaf; a language's leaves, in order of their ids, form a tree of runs of eight, and the languages' subroots
form one above it. Upward, a node sends its digest to its parent; a parent that has heard from all its children hashes them
and sends on. Downward, a node sends each child its siblings and the path above, so that at last every leaf holds the proof
that leads from it to the root, and folds it.

A node is placed by the leaf range it stands over, so the first LOCAL levels send within a partition and only one node in
ARITY**LOCAL shuffles. The depth is the logarithm of the rows, and so is the lineage: a lost executor costs its share of a
few short stages. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import MOST_SENT, numbered
from . import work

ARITY, LOCAL = 8, 2
#: Leaves that one task holds, some hundreds of bytes each.
LEAVES_A_TASK = 100_000
_TOP = -1  # in place of a language's rank: the tree over the subroots


def digest_of(*columns: Column) -> Column:
    """Lower-case hex sha256 over the columns: each its UTF-8 byte count, a colon and the value, or a hyphen if null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)).cast("binary"), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hash(children: Iterable[bytes]) -> bytes:
    return sha256(b"".join(children).hex().encode()).digest()


def _size(n: int, level: int) -> int:
    """Nodes of a level of a tree of n leaves."""
    return -(-n // ARITY**level)


def _height(n: int) -> int:
    level = 0
    while _size(n, level) > 1:
        level += 1
    return level


def _place(key: tuple[int, int, int]) -> int:
    """Nodes over one run of ARITY**LOCAL leaves are together; hashes of integers are the same in every process."""
    rank, level, index = key
    return hash((rank, max(level, LOCAL), index // ARITY ** max(0, LOCAL - level)))


class _Steps:
    """One superstep's functions, with what they need to know of all nodes: the number of partitions."""

    def __init__(self, parts: int):
        self.parts = parts

    def place(self, rdd: RDD) -> RDD:
        return rdd.partitionBy(self.parts, _place)

    def up(self, nodes: RDD, level: int) -> RDD:
        """Nodes (key, (n, children, digest)) of `level` from those below: send, and let every parent that is complete hash."""

        def send(records):
            for (rank, _, index), (n, _, digest) in records:
                if _size(n, level - 1) > 1:
                    yield (rank, level, index // ARITY), (index % ARITY, n, digest)

        def gather(records):
            inbox: dict = {}
            for key, (slot, n, digest) in records:
                inbox.setdefault(key, (n, {}))[1][slot] = digest
            for key, (n, heard) in inbox.items():
                expected = min(ARITY, _size(n, level - 1) - ARITY * key[2])
                if len(heard) != expected:
                    raise RuntimeError(f"node {key} heard from {len(heard)} of {expected} children")
                children = tuple(heard[k] for k in range(expected))
                yield key, (n, children, _hash(children))

        return self.place(nodes.mapPartitions(send, preservesPartitioning=level <= LOCAL)).mapPartitions(gather, preservesPartitioning=True)

    def meet(self, nodes: RDD, paths: RDD, then, local: bool) -> RDD:
        """then(key, node, path) over nodes and the paths sent to them; paths to others of the partition are for other calls."""

        def join(records):
            own, sent = {}, {}
            for key, (is_path, value) in records:
                (sent if is_path else own)[key] = value
            for key, path in sent.items():
                yield from then(key, own[key], path)

        tagged = self.place(nodes.mapValues(_node).union(paths.mapValues(_path)))
        return tagged.mapPartitions(join, preservesPartitioning=local)

    def down(self, nodes: RDD, paths: RDD, level: int, local: bool) -> RDD:
        """Each child's siblings put before its parent's path: (key, (root, subroot, ((slot, siblings), ...)))."""

        def send(key, node, path):
            rank, _, index = key
            root, subroot, above = path
            children = node[1]
            for k in range(len(children)):
                yield (rank, level - 1, index * ARITY + k), (root, subroot, ((k, children[:k] + children[k + 1 :]), *above))

        return self.place(self.meet(nodes, paths, send, local))


def _node(value):
    return False, value


def _path(value):
    return True, value


def _proof(leaf: bytes, entries) -> tuple[str, bytes]:
    """Hash of all siblings in order, and what the leaf folds to."""
    proof = sha256()
    for slot, siblings in entries:
        proof.update(b"".join(siblings).hex().encode())
        leaf = _hash((*siblings[:slot], leaf, *siblings[slot:]))
    return proof.hexdigest(), leaf


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf and forged (the leaf of the tampered row; null where the row is not tampered with), as bytes."""
    cols = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.crc32(cols["doc_id"].cast("string").cast("binary")) % 3 == 0
    forged = F.when(tampered, digest_of(*(cols | {"text": lowered(cols["text"])}).values()))
    return docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.unhex(digest_of(*cols.values())).alias("leaf"), F.unhex(forged).alias("forged"))


def manifest(found: DataFrame) -> DataFrame:
    """found(lang, doc_id, leaf, forged) -> doc_id, leaf, subroot, root, proof_sha256, folded_root (hex), verified.

    Leaves of a language ascend by id (null first), those of equal ids by digest. A null language is a language, the first.
    No rows give no rows.
    """
    spark = found.sparkSession
    work.ship(spark)
    placed = numbered(found, ["lang"], ["doc_id", "leaf"], "position", "size")
    langs = placed.where("position = 0").select(F.col("lang").alias("lang2"), F.col("size").alias("n"))
    langs = work.saved(numbered(langs, [], ["lang2"], "rank"), "merkle-languages")
    shape = langs.agg(F.count(F.lit(1)).alias("count"), F.max("n").alias("n"), F.sum("n").alias("rows")).first()
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not shape["count"]:
        return spark.createDataFrame([], schema)
    n_langs, tall, top_tall = shape["count"], _height(shape["n"]), _height(shape["count"])
    bounds = [F.lit(ARITY**k) for k in range(tall + 1)]
    height = sum((F.col("n") > b).cast("int") for b in bounds)
    heights = {r[0] for r in langs.select(height).distinct().collect()}  # at most one a level
    small = F.broadcast(langs) if n_langs <= MOST_SENT else langs
    rows = placed.join(small, F.col("lang").eqNullSafe(F.col("lang2"))).select("rank", "position", "n", "leaf", "forged", "doc_id")
    steps = _Steps(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shape["rows"] // LEAVES_A_TASK)))

    records = steps.place(rows.rdd.mapPartitions(_records))
    tree = [records.mapValues(_leaf_node)]
    for level in range(1, tall + 1):
        tree.append(steps.up(tree[-1], level))

    subroots = spark.sparkContext.union([tree[h].mapPartitions(_subroots(n_langs)) for h in sorted(heights)])
    top = [steps.place(subroots)]
    for level in range(1, top_tall + 1):
        top.append(steps.up(top[-1], level))

    paths = top[-1].mapValues(_start)
    for level in range(top_tall, 0, -1):
        paths = steps.down(top[level], paths, level, False)
    to_trees = steps.place(steps.meet(top[0], paths, _enter, False))

    down = None
    for level in range(tall, -1, -1):
        if level in heights:
            entering = to_trees.filter(lambda x, level=level: x[0][1] == level)
            down = entering if down is None else down.union(entering)
        if level and down is not None:
            down = steps.down(tree[level], down, level, level <= LOCAL)
    out = steps.meet(records, down, _verify, False)
    return work.saved(spark.createDataFrame(out, schema, verifySchema=False), "merkle")


def _records(rows) -> Iterator:
    for rank, position, n, leaf, forged, doc_id in rows:
        yield (rank, 0, position), (n, bytes(leaf), None if forged is None else bytes(forged), doc_id)


def _leaf_node(value):
    n, leaf, _, _ = value
    return n, (), leaf


def _subroots(n_langs: int):
    def run(records):
        for (rank, level, _), (n, _, digest) in records:
            if _size(n, level) == 1:
                yield (_TOP, 0, rank), (n_langs, level, digest)  # a subroot remembers its level in place of its children

    return run


def _start(node):
    return node[2], None, ()


def _enter(key, node, path):
    """From the tree of languages down into a language's own."""
    root, _, above = path
    _, level, digest = node
    yield (key[2], level, 0), (root, digest, above)


def _verify(key, value, path):
    _, leaf, forged, doc_id = value
    root, subroot, entries = path
    proof, folded = _proof(leaf if forged is None else forged, entries)
    yield doc_id, leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root


def op11(docs: DataFrame) -> DataFrame:
    """The manifest of all documents; see `leaves` and `manifest`. Columns besides the five hashed ones play no part."""
    return manifest(work.saved(leaves(docs), "merkle-leaves"))
