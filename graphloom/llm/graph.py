"""Connected components of an edge table, as DataFrame jobs; nothing is gathered on the driver but one row count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work


def components(edges: DataFrame, what: str = "cc") -> DataFrame:
    """edges(a, b) of one comparable type -> (node, comp), comp the smallest node reachable. Nodes without edges are absent.

    Contraction by smallest neighbours: each round every node takes the smallest label next to it, labels are
    followed twice (pointer jumping), and edges are rewritten between labels; edges inside one label vanish. Rounds go on
    until no edge is left: where names are hashes each round leaves a fraction of the nodes; a path whose names rise along
    it would lose three nodes a round only. Null ends are dropped; repeated edges and loops do no harm. Edges are counted
    each round; once they are few, a round is one task's work and shuffles nothing.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    n = 2 * edges.count()  # at least as many as nodes
    edges = work.alone(edges, n)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = work.saved(nodes.select("node", F.col("node").alias("comp")), f"{what}-labels")
    live = work.saved(_tidy(edges), f"{what}-edges")
    labels0, live0 = labels, live
    while m := 2 * live.count():
        live = work.alone(live, m)
        both = live.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n0"), F.least("a", "m").alias("m"))
        least = work.alone(work.saved(least, f"{what}-least"), m)
        one, two = least.select(F.col("n0").alias("n1"), F.col("m").alias("m1")), least.select(F.col("n0").alias("n2"), F.col("m").alias("m2"))
        hop = least.join(one, F.col("m") == F.col("n1"), "left").select("n0", F.coalesce("m1", "m").alias("m"))
        hop = hop.join(two, F.col("m") == F.col("n2"), "left").select(F.col("n0").alias("old"), F.coalesce("m2", "m").alias("new"))
        hop = work.alone(work.saved(hop, f"{what}-hop"), m)
        labels = work.alone(labels, n).join(hop, labels.comp == hop.old, "left").select("node", F.coalesce("new", "comp").alias("comp"))
        before, labels = labels0, work.saved(labels, f"{what}-labels")
        work.discard(before)
        labels0 = labels
        ha, hb = hop.select(F.col("old").alias("oa"), F.col("new").alias("na")), hop.select(F.col("old").alias("ob"), F.col("new").alias("nb"))
        live = live.join(ha, live.a == F.col("oa"), "left").join(hb, live.b == F.col("ob"), "left")
        live = live.select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"))
        before, live = live0, work.saved(_tidy(live), f"{what}-edges")
        work.discard(before, least, hop)
        live0 = live
    work.discard(live)
    return labels


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
