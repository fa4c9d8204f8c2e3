"""Entailed facts and types by set-at-a-time rules (the OWL 2 RL property and class rules), many graphs in one job.

The terminology is small and bounded (checked); its own consequences (what each property and class implies) are worked
out on the driver once, so data-sized joins happen only where a rule needs two facts: chains and transitivity (delta
joins to a fixpoint), intersections and restrictions. Everything else is one broadcast lookup.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import saved


#: Begins the names of chain states, which are no properties.
STATE = "state "


def chain_steps_back(chains: list[tuple]) -> list[tuple[str, str, str]]:
    """Chains as steps from their last property backwards, (p, state or pn, state or q): a state stands for the pairs that a
    suffix leads between. Fewer pairs than from the front where the later properties have one value each."""
    out = {}
    for *steps, q in chains:
        state = steps[-1]
        for k in range(len(steps) - 2, -1, -1):
            to = q if k == 0 else STATE + "to " + " ∘ ".join(steps[k:])
            out[steps[k], state, to] = True
            state = to
    return list(out)


def chain_steps(chains: list[tuple]) -> list[tuple[str, str, str]]:
    """Chains (p1, ..., pn, q) of any length as steps (state or p1, p, state or q). A state stands for the pairs that have read
    a prefix; chains that begin alike share it, so the steps are the automaton of all chains."""
    out = {}
    for *steps, q in chains:
        state = steps[0]
        for k, p in enumerate(steps[1:], 2):
            to = q if k == len(steps) else STATE + " ∘ ".join(steps[:k])
            out[state, p, to] = True
            state = to
    return list(out)


@dataclass
class Terminology:
    """Axioms without individuals, by kind. `some`: (p, D, C) for (exists p.D) below C; `only`: (C, p, D) for C below
    (all p.D); `exists`: (C, p, D) for C below (exists p.D); `intersections`: (C, operands), `unions`: (C, operands);
    `chains`: (p1, ..., pn, q); `expressions`: (left, right) of class expressions of any depth, written as tuples:
    ('and' | 'or', ...), ('not', C), ('some' | 'only', p, C), ('value', p, v), ('self', p), ('min' | 'max' | 'exact', n, p, C),
    ('one', v, ...), with ('inverse', p) for p. Expressions are for `reasoner.closure` only.
    `left_out`: (statement, reason) that a reader did not understand."""

    sub_property: list = field(default_factory=list)
    equivalent_property: list = field(default_factory=list)
    inverse: list = field(default_factory=list)
    symmetric: list = field(default_factory=list)
    transitive: list = field(default_factory=list)
    functional: list = field(default_factory=list)
    inverse_functional: list = field(default_factory=list)
    asymmetric: list = field(default_factory=list)
    irreflexive: list = field(default_factory=list)
    chains: list = field(default_factory=list)
    domain: list = field(default_factory=list)
    range: list = field(default_factory=list)
    sub_class: list = field(default_factory=list)
    equivalent_class: list = field(default_factory=list)
    intersections: list = field(default_factory=list)
    unions: list = field(default_factory=list)
    some: list = field(default_factory=list)
    only: list = field(default_factory=list)
    exists: list = field(default_factory=list)
    disjoint: list = field(default_factory=list)
    disjoint_property: list = field(default_factory=list)
    expressions: list = field(default_factory=list)
    left_out: list = field(default_factory=list)

    def size(self) -> int:
        return sum(len(v) for k, v in vars(self).items() if k != "left_out")

    def check(self, most: int = 200_000) -> None:
        if self.expressions:
            raise ValueError("nested class expressions are for reasoner.closure")
        if self.size() > most:
            raise ValueError(f"terminology of over {most} axioms")

    def property_implies(self) -> list[tuple[str, str, bool]]:
        """(p, q, inverted): every p-fact is a q-fact, inverted or not."""
        step = defaultdict(set)
        for p, q in self.sub_property:
            step[p].add((q, False))
        for p, q in self.equivalent_property:
            step[p].add((q, False))
            step[q].add((p, False))
        for p, q in self.inverse:
            step[p].add((q, True))
            step[q].add((p, True))
        for p in self.symmetric:
            step[p].add((p, True))
        out = set()
        for p in {x for x in step}:
            seen, todo = {(p, False)}, [(p, False)]
            while todo:
                q, turned = todo.pop()
                for r, turn in step[q]:
                    if (n := (r, turned != turn)) not in seen:
                        seen.add(n)
                        todo.append(n)
            out |= {(p, q, turned) for q, turned in seen}
        return sorted(out)

    def class_implies(self) -> list[tuple[str, str]]:
        """(c, d): every member of c is one of d."""
        step = defaultdict(set)
        for c, d in self.sub_class:
            step[c].add(d)
        for c, d in self.equivalent_class:
            step[c].add(d)
            step[d].add(c)
        for c, parts in self.unions:
            for d in parts:
                step[d].add(c)
        for c, parts in self.intersections:
            for d in parts:
                if isinstance(d, str):
                    step[c].add(d)
        out = set()
        for c in list(step):
            seen, todo = {c}, [c]
            while todo:
                for d in step[todo.pop()]:
                    if d not in seen:
                        seen.add(d)
                        todo.append(d)
            out |= {(c, d) for d in seen}
        return sorted(out)

    def self_rules(self) -> list[tuple[str, str]]:
        """(C, r): C below (exists p.D), p below q, q o q- below r, so members of C stand in r to themselves."""
        implies = defaultdict(set)
        for p, q, turned in self.property_implies():
            implies[p].add((q, turned))
        up = defaultdict(set)
        for c, d in self.class_implies():
            up[d].add(c)
        out = set()
        for c, p, _ in self.exists:
            reach = {(p, False)} | implies[p]
            for a, b, r in (x for x in self.chains if len(x) == 3):
                if (a, False) in reach and (b, True) in reach:
                    out |= {(x, r) for x in {c} | up[c]}
        return sorted(out)


#: Rows of a rule table that are sent to every executor; a larger one is joined by a shuffle.
MOST_SENT = 500_000


def _small(rows: list, spark, schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MOST_SENT else df


def expand_facts(facts: DataFrame, t: Terminology) -> DataFrame:
    """Facts with all that sub-property, equivalence, inverse and symmetry make of them; columns g, s, p, o."""
    t.check()
    rows = t.property_implies()
    if not rows:
        return facts.select("g", "s", "p", "o").distinct()
    table = _small(rows, facts.sparkSession, "p0 string, q string, turned boolean")
    j = facts.join(table, facts.p == F.col("p0"), "left")
    s = F.when(F.col("turned"), F.col("o")).otherwise(F.col("s"))
    o = F.when(F.col("turned"), F.col("s")).otherwise(F.col("o"))
    return j.select("g", s.alias("s"), F.coalesce("q", "p").alias("p"), o.alias("o")).distinct()


def close_facts(facts: DataFrame, t: Terminology, types: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """All entailed facts (g, s, p, o) of facts(g, s, p, o): delta joins for chains and transitive properties. Names are finite, so
    the rounds end by themselves; over `max_rounds`, if given, raise."""
    spark = facts.sparkSession
    every = expand_facts(facts, t)
    if types is not None and (rules := t.self_rules()):
        own = types.join(_small(rules, spark, "c0 string, r string"), F.col("c") == F.col("c0")).select("g", F.col("i").alias("s"), F.col("r").alias("p"), F.col("i").alias("o"))
        every = expand_facts(every.unionByName(own), t)
    rules = [*chain_steps(t.chains), *((p, p, p) for p in t.transitive)]
    if not rules:
        return every
    chains = _small(rules, spark, "p1 string, p2 string, q string")
    used = sorted({p for r in rules for p in r[:2]})
    every = saved(every, "facts")
    delta = every
    for n in itertools.count():
        if n == max_rounds:
            raise RuntimeError(f"facts still grow after {max_rounds} rounds")
        step = delta.where(F.col("p").isin(used))
        first = step.join(chains, F.col("p") == F.col("p1")).select("g", F.col("s").alias("a"), F.col("o").alias("m"), "p2", "q")
        second = every.where(F.col("p").isin(used)).select(F.col("g").alias("g2"), F.col("s").alias("s2"), F.col("p").alias("pp"), F.col("o").alias("b"))
        right = first.join(second, (F.col("g") == F.col("g2")) & (F.col("m") == F.col("s2")) & (F.col("p2") == F.col("pp"))).select("g", F.col("a").alias("s"), F.col("q").alias("p"), F.col("b").alias("o"))
        last = step.join(chains, F.col("p") == F.col("p2")).select("g", F.col("s").alias("m"), F.col("o").alias("b"), "p1", "q")
        before = every.where(F.col("p").isin(used)).select(F.col("g").alias("g2"), F.col("s").alias("a"), F.col("p").alias("pp"), F.col("o").alias("o2"))
        left = last.join(before, (F.col("g") == F.col("g2")) & (F.col("m") == F.col("o2")) & (F.col("p1") == F.col("pp"))).select("g", F.col("a").alias("s"), F.col("q").alias("p"), F.col("b").alias("o"))
        new = expand_facts(right.unionByName(left), t).join(every, ["g", "s", "p", "o"], "left_anti")
        new = saved(new, "facts-new")
        if new.isEmpty():
            break
        every = every.unionByName(new)  # each part is a table of its own, written once
        delta = new
    return every if all(len(x) == 3 for x in t.chains) else every.where(~F.col("p").startswith(STATE))


def expand_types(types: DataFrame, t: Terminology) -> DataFrame:
    rows = t.class_implies()
    if not rows:
        return types.select("g", "i", "c").distinct()
    j = types.join(_small(rows, types.sparkSession, "c0 string, d string"), F.col("c") == F.col("c0"), "left")
    return j.select("g", "i", F.coalesce("d", "c").alias("c")).distinct()


def close_types(types: DataFrame, facts: DataFrame, t: Terminology, max_rounds: int | None = None) -> DataFrame:
    """All entailed types (g, i, c); facts must be closed."""
    t.check()
    spark = types.sparkSession
    every = types.select("g", "i", "c")
    if t.domain:
        every = every.unionByName(facts.join(_small(t.domain, spark, "p0 string, c string"), F.col("p") == F.col("p0")).select("g", F.col("s").alias("i"), "c"))
    if t.range:
        every = every.unionByName(facts.join(_small(t.range, spark, "p0 string, c string"), F.col("p") == F.col("p0")).select("g", F.col("o").alias("i"), "c"))
    every = expand_types(every, t)
    if not (t.intersections or t.some or t.only):
        return every
    every = saved(every, "types")
    needs = [(c, k, d if isinstance(d, str) else d[0], "" if isinstance(d, str) else d[1], len(parts)) for c, parts in t.intersections for k, d in enumerate(parts)]
    for n in itertools.count():
        if n == max_rounds:
            raise RuntimeError(f"types still grow after {max_rounds} rounds")
        new = None
        if t.some:
            table = _small(t.some, spark, "p0 string, d string, c2 string")
            hit = facts.join(table, F.col("p") == F.col("p0")).select("g", "s", "o", "d", "c2")
            member = every.select(F.col("g").alias("g2"), F.col("i").alias("i2"), F.col("c").alias("c1"))
            found = hit.join(member, (F.col("g") == F.col("g2")) & (F.col("o") == F.col("i2")) & (F.col("d") == F.col("c1"))).select("g", F.col("s").alias("i"), F.col("c2").alias("c"))
            new = found
        if t.only:
            table = _small(t.only, spark, "c0 string, p0 string, d string")
            held = every.join(table, F.col("c") == F.col("c0")).select(F.col("g").alias("g2"), F.col("i").alias("i2"), "p0", "d")
            found = facts.join(held, (F.col("g") == F.col("g2")) & (F.col("s") == F.col("i2")) & (F.col("p") == F.col("p0"))).select("g", F.col("o").alias("i"), F.col("d").alias("c"))
            new = found if new is None else new.unionByName(found)
        if needs:
            table = _small(needs, spark, "c2 string, k int, d string, f string, n int")
            plain = every.join(table.where("f = ''"), F.col("c") == F.col("d")).select("g", "i", "c2", "k", "n")
            link = facts.join(table.where("f <> ''"), F.col("p") == F.col("d")).select("g", "s", "o", "f", "c2", "k", "n")
            member = every.select(F.col("g").alias("g2"), F.col("i").alias("i2"), F.col("c").alias("c1"))
            through = link.join(member, (F.col("g") == F.col("g2")) & (F.col("o") == F.col("i2")) & (F.col("f") == F.col("c1"))).select("g", F.col("s").alias("i"), "c2", "k", "n")
            full = plain.unionByName(through).groupBy("g", "i", "c2", "n").agg(F.countDistinct("k").alias("m")).where("m = n").select("g", "i", F.col("c2").alias("c"))
            new = full if new is None else new.unionByName(full)
        new = saved(expand_types(new, t).join(every, ["g", "i", "c"], "left_anti"), "types-new")
        if new.isEmpty():
            break
        every = every.unionByName(new)  # each part is a table of its own, written once
    return every


def violations(facts: DataFrame, types: DataFrame, t: Terminology) -> DataFrame:
    """(g, rule, x, y): contradictions among closed facts and types; a graph with none is consistent under these rules."""
    spark = facts.sparkSession
    out = spark.createDataFrame([], "g string, rule string, x string, y string")
    if t.disjoint:
        table = _small(t.disjoint, spark, "c0 string, d string")
        other = types.select(F.col("g").alias("g2"), F.col("i").alias("i2"), F.col("c").alias("c2"))
        out = out.unionByName(types.join(table, F.col("c") == F.col("c0")).join(other, (F.col("g") == F.col("g2")) & (F.col("i") == F.col("i2")) & (F.col("d") == F.col("c2"))).select("g", F.lit("disjoint").alias("rule"), F.col("i").alias("x"), F.concat_ws("|", "c", "d").alias("y")))
    if t.functional:
        many = facts.where(F.col("p").isin(t.functional)).groupBy("g", "s", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(many.select("g", F.lit("functional").alias("rule"), F.col("s").alias("x"), F.col("p").alias("y")))
    if t.inverse_functional:
        many = facts.where(F.col("p").isin(t.inverse_functional)).groupBy("g", "o", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(many.select("g", F.lit("inverse-functional").alias("rule"), F.col("o").alias("x"), F.col("p").alias("y")))
    if t.disjoint_property:
        table = _small(t.disjoint_property, spark, "p0 string, q string")
        other = facts.select(*(F.col(c).alias(f"{c}2") for c in ("g", "s", "p", "o")))
        both = facts.join(table, F.col("p") == F.col("p0")).join(other, (F.col("g") == F.col("g2")) & (F.col("s") == F.col("s2")) & (F.col("o") == F.col("o2")) & (F.col("q") == F.col("p2")))
        out = out.unionByName(both.select("g", F.lit("disjoint-property").alias("rule"), F.col("s").alias("x"), F.concat_ws("|", "o", "p", "q").alias("y")))
    if t.irreflexive:
        out = out.unionByName(facts.where(F.col("p").isin(t.irreflexive) & (F.col("s") == F.col("o"))).select("g", F.lit("irreflexive").alias("rule"), F.col("s").alias("x"), F.col("p").alias("y")))
    if t.asymmetric:
        back = facts.select(F.col("g").alias("g2"), F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
        out = out.unionByName(facts.where(F.col("p").isin(t.asymmetric)).join(back, (F.col("g") == F.col("g2")) & (F.col("s") == F.col("o2")) & (F.col("o") == F.col("s2")) & (F.col("p") == F.col("p2"))).select("g", F.lit("asymmetric").alias("rule"), F.col("s").alias("x"), F.col("o").alias("y")))
    return out
