"""Subgraphs around individuals, and counts over facts: joins on node names, all partial-aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import saved


def ends(facts: DataFrame) -> DataFrame:
    """(node, s, p, o): every fact once for each individual it mentions."""
    return facts.select(F.explode(F.array_distinct(F.array("s", "o"))).alias("node"), "s", "p", "o")


def one_hop(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, s, p, o): facts that mention the root; roots(root)."""
    return ends(facts).join(roots, F.col("node") == F.col("root")).select("root", "s", "p", "o")


def two_hop(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """One hop, and one hop of every individual in it (facts kept whole)."""
    near = one_hop(facts, roots)
    nodes = near.select("root", F.explode(F.array("s", "o")).alias("node")).distinct()
    return nodes.join(ends(facts), "node").select("root", "s", "p", "o").distinct()


def neighbours(facts: DataFrame) -> DataFrame:
    """(node, other), both directions, distinct."""
    return facts.select(F.col("s").alias("node"), F.col("o").alias("other")).union(facts.select("o", "s")).distinct()


def reachable(facts: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(root, node) within `hops` undirected steps; each round joins the frontier only."""
    near = neighbours(facts)
    seen = saved(roots.select("root", F.col("root").alias("node")), "reach")
    frontier = seen
    for _ in range(hops):
        step = frontier.join(near, "node").select("root", F.col("other").alias("node")).distinct()
        frontier = saved(step.join(seen, ["root", "node"], "left_anti"), "reach-new")
        if frontier.isEmpty():
            break
        seen = saved(seen.unionByName(frontier), "reach")
    return seen


def n_hop(facts: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(root, s, p, o): facts whose ends are both reachable within `hops`."""
    seen = reachable(facts, roots, hops)
    j = seen.join(facts, F.col("node") == F.col("s")).select("root", "s", "p", "o")
    return j.join(seen.select(F.col("root").alias("r2"), F.col("node").alias("n2")), (F.col("root") == F.col("r2")) & (F.col("o") == F.col("n2"))).select("root", "s", "p", "o")


def direct_type_names(types: DataFrame, most: int = 2) -> DataFrame:
    """(i, names): the first types by name joined with '_', 'Thing' without one."""
    named = F.slice(F.sort_array(F.collect_set(F.when(F.col("c") != "NamedIndividual", F.col("c")))), 1, most)
    return types.groupBy("i").agg(F.when(F.size(named) > 0, F.concat_ws("_", named)).otherwise("Thing").alias("names"))
