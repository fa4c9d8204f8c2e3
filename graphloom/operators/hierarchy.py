"""An index of a class hierarchy of any size: subsumption by interval, without a table of all pairs.

Classes that subsume each other are condensed to one. Every condensed class takes one of its superclasses as its tree parent;
a walk over the forest would meet a class's descendants in one run of numbers, its interval. Descendants by other edges add
the intervals they have, passed upward until an interval that covers them. c is below d when c's number lies in an interval
of d: an equality join on d and a range test.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import discard, saved
from .numbering import numbered


def condensed(edges: DataFrame) -> DataFrame:
    """(node, rep) of all nodes of edges(a, b) that lie on cycles; rep is the greatest name of their strong component.

    Nodes that nothing leads into or out of are cut off until none is left; of the rest every node takes the greatest name that
    leads to it, and those that the bearer of that name is led to by, within its colour, are its component. Components are
    taken out and the rest goes round again.
    """
    live, found = saved(edges.select("a", "b").where("a <> b").distinct(), "cycle-edges"), []
    while True:
        n = -1
        while (m := live.count()) != n:  # cut off what lies on no cycle
            n = m
            ahead, back = live.select(F.col("a").alias("x")).distinct(), live.select(F.col("b").alias("x")).distinct()
            kept = saved(live.join(back, F.col("a") == F.col("x"), "left_semi").join(ahead, F.col("b") == F.col("x"), "left_semi"), "cycle-edges")
            discard(live)
            live = kept
        if not n:
            break
        colour = saved(live.select(F.col("a").alias("node")).distinct().withColumn("c", F.col("node")), "cycle-colours")
        while True:
            reach = live.join(colour, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.max("c").alias("c2"))
            new = saved(colour.join(reach, "node", "left").select("node", F.greatest("c", "c2").alias("c"), (F.col("c2") > F.col("c")).alias("grew")), "cycle-colours")
            more = not new.where("grew").isEmpty()
            discard(colour)
            colour = new.select("node", "c")
            colour._scratch = new._scratch
            if not more:
                break
        own = live.join(colour.select(F.col("node").alias("na"), F.col("c").alias("ca")), F.col("a") == F.col("na")).join(colour.select(F.col("node").alias("nb"), F.col("c").alias("cb")), F.col("b") == F.col("nb"))
        own = saved(own.where("ca = cb").select("a", "b", F.col("ca").alias("c")), "cycle-own")
        part = [saved(colour.where("node = c").select("node", F.col("c").alias("rep")), "cycle-part")]
        delta = part[0]
        while True:  # who leads to the bearer of the colour, within it
            seen = reduce(DataFrame.unionByName, part)
            step = own.join(delta.withColumnRenamed("node", "x"), (F.col("b") == F.col("x")) & (F.col("c") == F.col("rep"))).select(F.col("a").alias("node"), "rep").distinct()
            delta = saved(step.join(seen, ["node", "rep"], "left_anti"), "cycle-part")
            if delta.isEmpty():
                break
            part.append(delta)
        done = reduce(DataFrame.unionByName, part)
        found.append(done)
        gone = done.select(F.col("node").alias("x"))
        rest = saved(live.join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti"), "cycle-edges")
        discard(live, colour, own)
        live = rest
    if not found:
        return edges.sparkSession.createDataFrame([], "node string, rep string")
    return reduce(DataFrame.unionByName, found)


@dataclass
class Hierarchy:
    """classes (class, rep, number): every class with its condensed class and that one's number; intervals (rep, low, high)."""

    classes: DataFrame
    intervals: DataFrame

    def below(self, asked: DataFrame, sub: str = "sub", sup: str = "sup") -> DataFrame:
        """asked with `holds`: whether sub is below sup, or the same. Classes the hierarchy doesn't name are below themselves."""
        c = self.classes.select(F.col("class").alias("_c"), F.col("number").alias("_n"))
        d = self.classes.select(F.col("class").alias("_d"), F.col("rep").alias("_r"))
        pairs = asked.select(sub, sup).distinct()
        hit = pairs.join(c, F.col(sub) == F.col("_c")).join(d, F.col(sup) == F.col("_d")).join(self.intervals, F.col("_r") == F.col("rep")).where("_n BETWEEN low AND high")
        hit = hit.select(F.col(sub).alias("_s"), F.col(sup).alias("_t")).distinct().withColumn("_hit", F.lit(True))
        out = asked.join(hit, (F.col(sub) == F.col("_s")) & (F.col(sup) == F.col("_t")), "left")
        return out.withColumn("holds", F.coalesce("_hit", F.col(sub) == F.col(sup))).drop("_s", "_t", "_hit")

    def descendants(self) -> DataFrame:
        """(class, n): how many classes are below each, itself not counted; from intervals alone."""
        sizes = self.classes.groupBy("rep").agg(F.count(F.lit(1)).alias("own"), F.min("number").alias("number"))
        before = numbered(sizes, [], ["number"], "before", "all", weight="own").select("rep", "number", "own", "before")
        at = before.select(F.col("number").alias("low"), F.col("before").alias("b0"))
        end = before.select(F.col("number").alias("high"), (F.col("before") + F.col("own")).alias("b1"))
        n = self.intervals.join(at, "low").join(end, "high").groupBy("rep").agg(F.sum(F.col("b1") - F.col("b0")).alias("n"))
        return self.classes.join(n, "rep").select("class", (F.col("n") - 1).alias("n"))


def _outermost(every: DataFrame) -> DataFrame:
    """Intervals (rep, low, high) that no other of the same rep holds. They nest or lie apart, so in ascending order, longer
    ones first, one lies within another if an earlier one reaches as far: a running maximum over a range sort, within files
    and then over files, whatever a rep's number of intervals."""
    keys = ["rep", "low", F.col("high").desc()]
    table = saved(every.distinct().repartitionByRange(*keys).sortWithinPartitions(*keys), "hierarchy-sorted")
    table = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    earlier = Window.partitionBy("_file", "rep").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    files = table.groupBy("_file", "rep").agg(F.max("high").alias("_most"))
    many = files.groupBy("rep").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("rep")  # at most one a file
    before = Window.partitionBy("rep").orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.join(F.broadcast(many), "rep", "left_semi").select(F.col("_file").alias("_f"), F.col("rep").alias("_r"), F.max("_most").over(before).alias("_before"))
    reached = table.withColumn("_reach", F.max("high").over(earlier)).join(F.broadcast(files), (F.col("_file") == F.col("_f")) & (F.col("rep") == F.col("_r")), "left")
    return reached.where(F.coalesce(F.greatest("_reach", "_before") < F.col("high"), F.lit(True))).select("rep", "low", "high")


def _along(nodes: DataFrame, value: str) -> DataFrame:
    """(rep, `value`, root) with the values of a forest's nodes (rep, parent, value) added up to their roots: the parents'
    parents are followed, so there are as many rounds as the depth's logarithm."""
    now = saved(nodes.select("rep", "parent", value), "forest")
    while not now.where("parent IS NOT NULL").isEmpty():
        up = now.select(F.col("rep").alias("_r"), F.col("parent").alias("_p"), F.col(value).alias("_v"))
        new = saved(now.join(up, F.col("parent") == F.col("_r"), "left").select("rep", F.col("_p").alias("parent"), (F.col(value) + F.coalesce("_v", F.lit(0))).alias(value)), "forest")
        discard(now)
        now = new
    return now


def index(edges: DataFrame) -> Hierarchy:
    """The hierarchy of edges(sub, sup): loops, cycles, repeated edges and several superclasses are fine; null ends are no edges."""
    pairs = saved(edges.where("sub IS NOT NULL AND sup IS NOT NULL").select("sub", "sup").distinct(), "hierarchy")
    on_cycle = condensed(pairs.select(F.col("sub").alias("a"), F.col("sup").alias("b")))
    names = pairs.select(F.explode(F.array("sub", "sup")).alias("class")).distinct()
    names = saved(names.join(on_cycle, F.col("class") == F.col("node"), "left").select("class", F.coalesce("rep", "class").alias("rep")), "hierarchy-classes")
    a, b = names.select(F.col("class").alias("sub"), F.col("rep").alias("x")), names.select(F.col("class").alias("sup"), F.col("rep").alias("y"))
    dag = saved(pairs.join(a, "sub").join(b, "sup").select("x", "y").where("x <> y").distinct(), "hierarchy-edges")
    parents = dag.groupBy("x").agg(F.min("y").alias("parent"))
    forest = names.select("rep").distinct().join(parents, F.col("rep") == F.col("x"), "left").select("rep", "parent")
    forest = saved(forest, "hierarchy-forest")
    depth = saved(_along(forest.withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(1)), "depth").select("rep", "depth"), "hierarchy-depth")
    placed = saved(forest.join(depth, "rep"), "hierarchy-placed")
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    sizes = saved(placed.where(F.col("depth") == deepest).select("rep", "parent", F.lit(1).cast("long").alias("size")), "hierarchy-sizes")
    levels = [sizes]
    for k in range(deepest - 1, -1, -1):  # from the leaves up; a level's sizes are one sum over the level below
        below = levels[-1].groupBy(F.col("parent").alias("p")).agg(F.sum("size").alias("s"))
        level = placed.where(F.col("depth") == k).join(below, F.col("rep") == F.col("p"), "left")
        levels.append(saved(level.select("rep", "parent", (1 + F.coalesce("s", F.lit(0))).cast("long").alias("size")), "hierarchy-sizes"))
    sized = reduce(DataFrame.unionByName, levels)
    steps = numbered(sized, ["parent"], ["rep"], "earlier", weight="size")
    steps = steps.withColumn("step", F.col("earlier") + F.when(F.col("parent").isNull(), 0).otherwise(1))
    numbers = _along(steps.select("rep", "parent", "step"), "step").select(F.col("rep").alias("r"), F.col("step").alias("number"))
    own = saved(sized.join(numbers, F.col("rep") == F.col("r")).select("rep", "number", (F.col("number") + F.col("size") - 1).alias("high")), "hierarchy-own")

    # intervals by other edges, upward until one that covers them
    x, y = (own.select(*(F.col(c).alias(f"{c}_{k}") for c in own.columns)) for k in "xy")
    links = saved(dag.join(x, F.col("x") == F.col("rep_x")).join(y, F.col("y") == F.col("rep_y")).select("x", "y", "number_x", "high_x", "number_y", "high_y"), "hierarchy-links")
    outside = ~((F.col("low") >= F.col("number_y")) & (F.col("high") <= F.col("high_y")))
    delta = saved(links.select("y", F.col("number_x").alias("low"), F.col("high_x").alias("high"), "number_y", "high_y").where(outside).select(F.col("y").alias("rep"), "low", "high").distinct(), "hierarchy-more")
    more = [delta]
    while not delta.isEmpty():
        up = delta.join(links, F.col("rep") == F.col("x")).where(outside).select(F.col("y").alias("rep"), "low", "high").distinct()
        delta = saved(up.join(reduce(DataFrame.unionByName, more), ["rep", "low", "high"], "left_anti"), "hierarchy-more")
        more.append(delta)
    every = own.select("rep", F.col("number").alias("low"), "high").unionByName(reduce(DataFrame.unionByName, more))
    inner = _outermost(every)
    classes = names.join(own.select("rep", "number"), "rep").select("class", "rep", "number")
    return Hierarchy(saved(classes, "hierarchy-numbers"), saved(inner, "hierarchy-intervals"))
