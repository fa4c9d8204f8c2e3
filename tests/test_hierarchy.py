"""Subsumption by intervals against reachability in Python: several parents, cycles, loops, deep and wide hierarchies."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import hierarchy, numbering


def reach(edges):
    up = {}
    for a, b in edges:
        if a and b:
            up.setdefault(a, set()).add(b)
            up.setdefault(b, set())
    out = {}
    for c in up:
        seen, todo = {c}, [c]
        while todo:
            for d in up[todo.pop()]:
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        out[c] = seen
    return out


@pytest.mark.parametrize("kind", ["dag", "cycles"])
def test_subsumption(spark, kind):
    random.seed(6)
    n = 60
    edges = [(f"c{k:02d}", f"c{random.randrange(k):02d}") for k in range(1, n)] + [(f"c{max(a, b):02d}", f"c{min(a, b):02d}") for a, b in (random.sample(range(n), 2) for _ in range(25))]
    if kind == "cycles":
        edges += [("c03", "c40"), ("c10", "c11"), ("c11", "c10"), ("c05", "c05"), ("z1", "z2"), ("z2", "z3"), ("z3", "z1"), (None, "c01"), ("c59", "z1"), *edges[:5]]
    want = reach(edges)
    h = hierarchy.index(spark.createDataFrame(edges, "sub string, sup string"))
    names = sorted(want)
    asked = spark.createDataFrame([(a, b) for a in names for b in names] + [("new", "new"), ("new", "c01")], "sub string, sup string")
    got = {(r["sub"], r["sup"]) for r in h.below(asked).where("holds").collect()}
    assert got == {(a, b) for a in names for b in want[a]} | {("new", "new")}
    assert {r["class"]: r.n for r in h.descendants().collect()} == {d: sum(d in want[c] for c in names) - 1 for d in names}


def test_no_edges(spark):
    h = hierarchy.index(spark.createDataFrame([], "sub string, sup string"))
    assert h.classes.count() == h.intervals.count() == 0


def test_outermost_of_one_class_with_many_intervals(spark):
    """200,000 intervals of one class: comparing them in pairs would take 40,000,000,000 steps."""
    n = 200_000
    apart = spark.range(n, numPartitions=8).select(F.lit("hot").alias("rep"), (F.col("id") * 4).alias("low"), (F.col("id") * 4 + 3).alias("high"))
    within = apart.where("low % 3 = 0").select("rep", (F.col("low") + 1).alias("low"), (F.col("high") - 1).alias("high"))
    small = [("a", 0, 9), ("a", 0, 3), ("a", 0, 9), ("a", 4, 9), ("a", 12, 12), ("a", 10, 11), ("b", 5, 5)]
    every = apart.union(within).union(spark.createDataFrame(small, "rep string, low long, high long"))
    got = hierarchy._outermost(every)
    assert {tuple(r) for r in got.where("rep <> 'hot'").collect()} == {("a", 0, 9), ("a", 10, 11), ("a", 12, 12), ("b", 5, 5)}
    assert got.where("rep = 'hot'").count() == n and got.where("rep = 'hot' AND low % 4 = 0 AND high = low + 3").count() == n


def test_weights(spark):
    rows = [("a", k, k % 4) for k in range(50)] + [("b", 1, 7)]
    got = {(r.g, r.k): (r.before, r.all) for r in numbering.numbered(spark.createDataFrame(rows, "g string, k int, w int"), ["g"], ["k"], "before", "all", 3, "w").collect()}
    assert got == {(g, k): (sum(w2 for g2, k2, w2 in rows if g2 == g and k2 < k), sum(w2 for g2, _, w2 in rows if g2 == g)) for g, k, _ in rows}
