"""Closure of facts, types and equality together, under rules of a terminology of any nesting; many graphs in one job.

Every round joins what is new with what is there (semi-naive), as DataFrame jobs over one table (g, s, k, o); see `rules`.
When facts and types have settled, names that must be one are merged by connected components, rows that mention them are
rewritten to the least name and count as new, until nothing changes. Facts of keys that no rule names take no part in the
rounds. Anonymous successors are followed in the terminology, before any data is read: classes as their own members.

No new individuals arise, so the rounds end by themselves; there is no bound on them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialise import discard, saved
from . import equality
from .closure import MOST_SENT, Terminology
from .rules import STATE, TYPE, Rules, compiled, composed, pick

#: Keys that a filter names one by one.
MOST_NAMED = 5_000
SAME = "owl:sameAs"
_SAMES = [SAME, "http://www.w3.org/2002/07/owl#sameAs"]
_DIFFERENT = ["owl:differentFrom", "http://www.w3.org/2002/07/owl#differentFrom"]


@dataclass
class Closed:
    """facts (g, s, p, o) and types (g, i, c) over representatives; same (g, node, rep) for every name that was merged."""

    facts: DataFrame
    types: DataFrame
    same: DataFrame

    def all_facts(self) -> DataFrame:
        """Facts with every name of their ends."""
        return equality.aliases(equality.aliases(self.facts, "s", self.same), "o", self.same)

    def all_types(self) -> DataFrame:
        return equality.aliases(self.types, "i", self.same)


def table_of(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rules as a table; sent whole to the executors only while it is small."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MOST_SENT else df


def encoded(facts: DataFrame, types: DataFrame) -> DataFrame:
    a = facts.select("g", "s", F.col("p").alias("k"), "o")
    return a.unionByName(types.select("g", F.col("i").alias("s"), F.concat(F.lit(TYPE), "c").alias("k"), F.col("i").alias("o")))


def _end(letters: Column, n: int, s: str = "s", o: str = "o") -> Column:
    return F.when(F.substring(letters, n, 1) == "s", F.col(s)).otherwise(F.col(o))


def _expanded(rows: DataFrame, one: DataFrame | None) -> DataFrame:
    """rows and all that rules of one premise make of them."""
    if one is None:
        return rows.select("g", "s", "k", "o")
    more = rows.join(one, F.col("k") == F.col("k0")).select("g", _end(F.col("ends"), 1).alias("s"), F.col("k1").alias("k"), _end(F.col("ends"), 2).alias("o"))
    return rows.select("g", "s", "k", "o").unionByName(more)


class _Tables:
    """The rules of one run as tables."""

    def __init__(self, spark: SparkSession, r: Rules, wanted: set[str] | None = None):
        rows = lambda part, n: [x[:n] for x in part]
        make = lambda part, n, schema: table_of(spark, list(dict.fromkeys(rows(part, n))), schema) if part else None
        ones = composed(r.one)
        self.one = table_of(spark, ones, "k0 string, k1 string, ends string") if ones else None
        self.two = make(r.two, 4, "ka string, kb string, k1 string, ends string")
        self.left, self.right = sorted({x[0] for x in r.two}), sorted({x[1] for x in r.two})
        self.value = make(r.value, 3, "k0 string, v string, k1 string")
        self.gives = make(r.gives, 3, "k0 string, k1 string, v string")
        self.loops = make(r.loops, 2, "k0 string, k1 string")
        heads = {x[2] for x in [*r.two, *r.value]} | {x[1] for x in [*r.gives, *r.loops]}
        #: Keys of what `derived` concludes and rules of one premise make of it.
        self.heads = heads | {k1 for k0, k1, _ in ones if k0 in heads}
        premises = {x[0] for part in (r.value, r.gives, r.loops, r.back, r.single) for x in part} | {k for x in r.two for k in x[:2]} | {k for x in r.unique for k in x[:3] if k}
        self.kept = None if wanted is None else sorted(wanted | premises | set(_SAMES))

    def expanded(self, rows: DataFrame) -> DataFrame:
        out = _expanded(rows, self.one)
        return out if self.kept is None else out.where(F.col("k").isin(self.kept))

    def derived(self, delta: DataFrame, old: list[DataFrame]) -> DataFrame | None:
        """What follows from delta, and from it and old facts together."""
        out, every = [], reduce(DataFrame.unionByName, [*old, delta])
        if self.value is not None:
            out.append(delta.join(self.value, (F.col("k") == F.col("k0")) & (F.col("o") == F.col("v"))).select("g", "s", F.col("k1").alias("k"), F.col("s").alias("o")))
        if self.gives is not None:
            out.append(delta.join(self.gives, F.col("k") == F.col("k0")).select("g", "s", F.col("k1").alias("k"), F.col("v").alias("o")))
        if self.loops is not None:
            out.append(delta.where("s = o").join(self.loops, F.col("k") == F.col("k0")).select("g", "s", F.col("k1").alias("k"), "o"))
        if self.two is not None:
            ends = lambda df, a, b, m: df.select(
                "g", F.when(F.col("ends") == "bb", F.col(b)).otherwise(F.col(a)).alias("s"), F.col("k1").alias("k"), F.when(F.col("ends") == "aa", F.col(a)).otherwise(F.col(b)).alias("o"))
            first = delta.join(self.two, F.col("k") == F.col("ka")).select("g", F.col("s").alias("a"), F.col("o").alias("m"), "kb", "k1", "ends")
            second = every.where(F.col("k").isin(self.right)).select(F.col("g").alias("g2"), F.col("s").alias("m2"), F.col("k").alias("kk"), F.col("o").alias("b"))
            out.append(ends(first.join(second, (F.col("g") == F.col("g2")) & (F.col("m") == F.col("m2")) & (F.col("kb") == F.col("kk"))), "a", "b", "m"))
        if self.two is not None and old:
            last = delta.join(self.two, F.col("k") == F.col("kb")).select("g", F.col("s").alias("m"), F.col("o").alias("b"), "ka", "k1", "ends")
            before = reduce(DataFrame.unionByName, old).where(F.col("k").isin(self.left)).select(F.col("g").alias("g2"), F.col("s").alias("a"), F.col("k").alias("kk"), F.col("o").alias("m2"))
            out.append(ends(last.join(before, (F.col("g") == F.col("g2")) & (F.col("m") == F.col("m2")) & (F.col("ka") == F.col("kk"))), "a", "b", "m"))
        return reduce(DataFrame.unionByName, out) if out else None


def _settled(every: list[DataFrame], rules: _Tables) -> list[DataFrame]:
    """The parts of the closure: `every` and what follows from its last, which is new, with the others. New facts are looked
    for among facts of the keys that rules conclude only."""
    while True:
        new = rules.derived(every[-1], every[:-1])
        if new is None:
            return every
        known = reduce(DataFrame.unionByName, every)
        if len(rules.heads) <= MOST_NAMED:
            known = known.where(F.col("k").isin(sorted(rules.heads)))
        delta = saved(rules.expanded(new).distinct().join(known, ["g", "s", "k", "o"], "left_anti"), "closure-new")
        if delta.isEmpty():
            discard(delta)
            return every
        every = [*every, delta]


def _pairs(every: DataFrame, r: Rules) -> DataFrame | None:
    """(g, a, b): names that rules say are one; one of a group's names with each other, never all pairs."""
    spark, out = every.sparkSession, []
    said = every.where(F.col("k").isin(_SAMES)).select("g", F.col("s").alias("a"), F.col("o").alias("b"))
    out.append(said)

    def one_each(values: DataFrame, by: list[str], name: str) -> DataFrame:
        least = values.groupBy(*by).agg(F.min(name).alias("m"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
        least = least.select(*(F.col(c).alias(f"_{c}") for c in by), "m")
        same = reduce(lambda x, y: x & y, (F.col(c) == F.col(f"_{c}") for c in by))
        return values.join(least, same).where(F.col(name) != F.col("m")).select("g", F.col(name).alias("a"), F.col("m").alias("b"))

    plain = sorted({p for c, p, f, *_ in r.unique if not c and not f})
    if plain:
        out.append(one_each(every.where(F.col("k").isin(plain)).select("g", "s", "k", "o"), ["g", "s", "k"], "o"))
    if back := sorted({x[0] for x in r.back}):
        out.append(one_each(every.where(F.col("k").isin(back)).select("g", "s", "k", "o"), ["g", "o", "k"], "s"))
    if limits := sorted({x[:3] for x in r.unique if x[0] or x[2]}):
        table = table_of(spark, [(n, *x) for n, x in enumerate(limits)], "n int, c string, p string, f string")
        member = every.where(F.col("k").isin(sorted({k for x in limits for k in (x[0], x[2]) if k}))).select(F.col("g").alias("g2"), F.col("s").alias("i2"), F.col("k").alias("k2"))
        found = every.join(table, F.col("k") == F.col("p")).select("g", "s", "o", "n", "c", "f")
        for name, key in (("s", "c"), ("o", "f")):
            free, bound = found.where(F.col(key) == ""), found.where(F.col(key) != "")
            found = free.unionByName(bound.join(member, (F.col("g") == F.col("g2")) & (F.col(name) == F.col("i2")) & (F.col(key) == F.col("k2")), "left_semi"))
        out.append(one_each(found.select("g", "s", "n", "o").distinct(), ["g", "s", "n"], "o"))
    if r.single:
        table = table_of(spark, sorted({x[:2] for x in r.single}), "k0 string, v string")
        out.append(every.join(table, F.col("k") == F.col("k0")).select("g", F.col("s").alias("a"), F.col("v").alias("b")))
    return reduce(DataFrame.unionByName, out).where("a <> b")


def _successors(spark: SparkSession, r: Rules) -> Rules:
    """Rules that follow from anonymous successors: each class is its own member, each kind of successor a node, and the same
    rounds run over them. Statements that look back from the successor, or on all values, are not made of these nodes."""
    if not r.exists:
        return r
    node = lambda k: f"some {k}"
    classes = sorted({k for k in r.keys() if k.startswith(TYPE)} | {k for x in [*r.one, *r.exists] for k in x[:3] if k.startswith(TYPE)} | {x[2] for x in r.two if x[2].startswith(TYPE)})
    after = {(k0, k1) for k0, k1, ends in composed(r.one) if ends == "oo" and k1.startswith(TYPE)}
    gives, seeds = [], [("", f"member {k}", k, f"member {k}") for k in classes]
    for k, p, b, _ in r.exists:
        kind = node(f"{p} {b}")
        gives.append((k, p, kind, ()))
        seeds += [("", kind, x, kind) for x in [b, *sorted(c for q, c in after if q == p)]]
    inner = replace(
        r, one=[x for x in r.one if x[0].startswith(TYPE) or x[2] in ("so", "ss")], two=[x for x in r.two if x[3] != "bb"],
        gives=[*r.gives, *gives], unique=[], back=[], single=[], nominal=[], never=[], exists=[],
    )
    tables = _Tables(spark, inner)
    start = saved(_expanded(spark.createDataFrame(sorted(set(seeds)), "g string, s string, k string, o string"), tables.one).distinct(), "successors")
    parts = _settled([start], tables)
    known = {(k0, k1) for k0, k1, _ in composed(r.one)}
    found = reduce(DataFrame.unionByName, parts).where(F.col("s").startswith("member ") & F.col("k").startswith(TYPE)).select("s", "k").distinct()
    rows = [(x.s[len("member ") :], x.k) for x in found.limit(MOST_SENT + 1).collect()]
    if len(rows) > MOST_SENT:
        raise ValueError(f"over {MOST_SENT} class pairs follow from successors")
    discard(*parts)
    new = [(a, b, "so", (f"{a[len(TYPE) :]} SubClassOf {b[len(TYPE) :]}",)) for a, b in sorted(rows) if a != b and (a, b) not in known]
    return replace(r, one=[*r.one, *new])


def prepared(spark: SparkSession, t: Terminology | Rules, strict: bool = True) -> Rules:
    """Compiled rules with what follows from anonymous successors."""
    return _successors(spark, t if isinstance(t, Rules) else compiled(t, strict))


def closure(facts: DataFrame, types: DataFrame, t: Terminology | Rules, strict: bool = True, wanted: set[str] | None = None) -> Closed:
    """All entailed facts, types and equalities of facts (g, s, p, o) and types (g, i, c); graphs don't mix.

    t: a terminology, compiled here (what no rule covers raises NotUnderstood unless strict is False), or prepared rules.
    wanted: properties (classes as 'type C') whose facts are asked for; all of those are given, and others are left out as soon
    as nothing wanted needs them. Null ends are no facts. Empty tables give empty tables.
    """
    spark = facts.sparkSession
    r = t if isinstance(t, Rules) else prepared(spark, t, strict)
    tables = _Tables(spark, r, wanted)
    rows = encoded(facts, types).where("g IS NOT NULL AND s IS NOT NULL AND k IS NOT NULL AND o IS NOT NULL")
    if r.nominal:
        named = table_of(spark, sorted({x[:2] for x in r.nominal}), "v string, k1 string")
        nodes = rows.select("g", F.explode(F.array("s", "o")).alias("node"))
        rows = rows.unionByName(nodes.join(named, F.col("node") == F.col("v")).select("g", F.col("node").alias("s"), F.col("k1").alias("k"), F.col("node").alias("o")).distinct())
    merging = bool(r.unique or r.back or r.single)
    used = sorted(r.keys() | set(_SAMES))
    active = F.col("k").isin(used)
    aside = rows.where(~active if wanted is None else ~active & F.col("k").isin(sorted(wanted))).distinct()
    start = saved(tables.expanded(rows.where(active)).distinct(), "closure")
    every = _settled([start], tables)
    merging = merging or not start.where(F.col("k").isin(_SAMES)).isEmpty()
    same = spark.createDataFrame([], "g string, node string, rep string")
    while merging:
        whole = reduce(DataFrame.unionByName, every)
        merged = equality.representatives(_pairs(whole, r)).where("node <> rep")
        if merged.isEmpty():
            break
        merged = saved(merged, "merged")
        same = equality.rewritten(same.withColumnRenamed("rep", "r"), ["r"], merged).withColumnRenamed("r", "rep").unionByName(merged)
        moved = equality.rewritten(whole.select("*", F.col("s").alias("s0"), F.col("o").alias("o0")), ["s", "o"], merged)
        moved = saved(moved.select("g", "s", "k", "o", ((F.col("s") != F.col("s0")) | (F.col("o") != F.col("o0"))).alias("moved")), "moved")
        rest = moved.where("NOT moved").drop("moved")
        fresh = moved.where("moved").drop("moved").where(~(F.col("k").isin(_SAMES) & (F.col("s") == F.col("o"))))
        new = saved(tables.expanded(fresh).distinct().join(rest, ["g", "s", "k", "o"], "left_anti"), "rewritten")
        discard(*every)
        every = _settled([rest, new], tables)
    whole = reduce(DataFrame.unionByName, every)
    if merging:
        aside = equality.rewritten(aside, ["s", "o"], same).select("g", "s", "k", "o").distinct()
    out = whole.unionByName(aside)
    shown = ~F.col("k").startswith(STATE) & ~F.col("k").startswith(TYPE)
    kinds = F.col("k").startswith(TYPE) & ~F.col("k").startswith(TYPE + "nested ")
    return Closed(
        out.where(shown).select("g", "s", F.col("k").alias("p"), "o"),
        out.where(kinds).select("g", F.col("s").alias("i"), F.substring("k", len(TYPE) + 1, 1 << 30).alias("c")), same,
    )


def contradictions(closed: Closed, t: Terminology | Rules) -> DataFrame:
    """(g, rule, x, y): what a closure contradicts. Members of classes that share none (also complements and upper bounds of
    zero), pairs in two properties that share none, irreflexive and asymmetric facts, and names said to differ that are one.
    The inner classes of expressions are not kept in a closure, so `t` should name what it forbids, or be used on `whole`."""
    spark = closed.facts.sparkSession
    rules = t if isinstance(t, Rules) else compiled(t, False)
    rows = encoded(closed.facts, closed.types)
    out = spark.createDataFrame([], "g string, rule string, x string, y string")
    for name, part in (("disjoint", rules.never), ("disjoint-property", rules.apart)):
        if part:
            table = table_of(spark, sorted({x[:2] for x in part}), "k1 string, k2 string")
            other = rows.select(*(F.col(c).alias(f"{c}2") for c in ("g", "s", "o")), F.col("k").alias("kk"))
            j = rows.join(table, F.col("k") == F.col("k1")).join(other, (F.col("g") == F.col("g2")) & (F.col("s") == F.col("s2")) & (F.col("o") == F.col("o2")) & (F.col("k2") == F.col("kk")))
            strip = lambda c: F.regexp_replace(c, f"^{TYPE}", "")
            out = out.unionByName(j.select("g", F.lit(name).alias("rule"), F.col("s").alias("x"), F.concat_ws("|", strip("k1"), strip("k2")).alias("y")).distinct())
    told = equality.rewritten(closed.facts.where(F.col("p").isin(_DIFFERENT)), ["s", "o"], closed.same)
    return out.unionByName(told.where("s = o").select("g", F.lit("different").alias("rule"), F.col("s").alias("x"), F.col("o").alias("y")))
