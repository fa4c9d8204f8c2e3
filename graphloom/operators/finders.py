"""Explanation finders that trace a conclusion back to asserted statements, and finders over class expressions.

Path rows are those of `paths`; where several witnesses would do, the smallest by name is taken. Terminology sides are
broadcast after a check of their size; facts and types are joined on their keys and grouped with partial sums.

Defined cases: empty facts, types or rules give no paths; repeated facts and types count once; a null in a fact or type
gives no path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import Terminology, _small
from .paths import _along, _axiom, _path, fact_text


def _told(facts: DataFrame) -> DataFrame:
    return facts.select("s", "p", "o").dropna().distinct()


def _below(pairs: list[tuple[str, str]]) -> dict[str, set[str]]:
    """Everything strictly below each name, however deep; cycles end."""
    down: dict[str, set[str]] = {}
    for a, b in pairs:
        down.setdefault(b, set()).add(a)
    out = {}
    for top in down:
        seen, todo = set(), [top]
        while todo:
            for x in down.get(todo.pop(), ()):
                if x not in seen and x != top:
                    seen.add(x)
                    todo.append(x)
        out[top] = seen
    return out


def traces(facts: DataFrame, t: Terminology, properties: list[str]) -> DataFrame:
    """(i, p, kind, evidence): why i has a value of p, by asserted facts: such a fact, one of a sub-property at any depth,
    one of an inverse, or a chain; the first kind in this order, the smallest facts by name within it."""
    spark = facts.sparkSession
    told = _told(facts).where(F.col("p").isin(sorted(_used(t, properties))))
    text = fact_text(F.col("s"), F.col("p"), F.col("o"))
    row = lambda df, i, p, k, kind, evidence: df.select(i.alias("i"), p.alias("p"), F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), evidence.alias("evidence")).alias("e"))
    parts = [row(told.where(F.col("p").isin(properties)), F.col("s"), F.col("p"), 1, "asserted", F.array(text))]
    below = _below(t.sub_property)
    sub = sorted((q, p) for p in properties for q in below.get(p, ()))
    if sub:
        parts.append(row(told.join(_small(sub, spark, "q string, target string"), F.col("p") == F.col("q")), F.col("s"), F.col("target"), 2, "sub-property", F.array(text)))
    inverse = sorted({(q, p) for a, b in t.inverse for p, q in ((a, b), (b, a)) if p in properties})
    if inverse:
        parts.append(row(told.join(_small(inverse, spark, "q string, target string"), F.col("p") == F.col("q")), F.col("o"), F.col("target"), 3, "inverse", F.array(text)))
    chains = [c for c in t.chains if len(c) == 3 and c[2] in properties]
    if chains:
        first = told.join(_small(chains, spark, "p1 string, p2 string, target string"), F.col("p") == F.col("p1")).select(F.col("s").alias("a"), text.alias("ta"), F.col("o").alias("m"), "p2", "target")
        # one edge a middle will do, so a hot middle meets one row
        second = told.where(F.col("p").isin(sorted({c[1] for c in chains}))).groupBy(F.col("s").alias("m2"), F.col("p").alias("pp")).agg(F.min(text).alias("tb"))
        both = first.join(second, (F.col("m") == F.col("m2")) & (F.col("p2") == F.col("pp")))
        parts.append(row(both, F.col("a"), F.col("target"), 4, "chain", F.array("ta", "tb")))
    for *steps, q in (c for c in t.chains if len(c) > 3 and c[-1] in properties):
        ways = _along(told, steps).groupBy("a").agg(F.min("nodes").alias("nodes"))
        parts.append(row(ways, F.col("a"), F.lit(q), 4, "chain", F.array(*(fact_text(F.col("nodes")[k], F.lit(x), F.col("nodes")[k + 1]) for k, x in enumerate(steps)))))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("i", "p").agg(F.min("e").alias("e")).select("i", "p", "e.kind", "e.evidence")


def _used(t: Terminology, properties: list[str]) -> set[str]:
    below = _below(t.sub_property)
    out = set(properties)
    for p in properties:
        out |= below.get(p, set())
    for a, b in t.inverse:
        out |= {b} if a in properties else set()
        out |= {a} if b in properties else set()
    for *steps, q in t.chains:
        out |= set(steps) if q in properties else set()
    return out


def reverse_traces(facts: DataFrame, properties: list[str]) -> DataFrame:
    """(i, p, evidence): the smallest asserted fact of p that ends at i."""
    told = _told(facts).where(F.col("p").isin(properties))
    return told.groupBy(F.col("o").alias("i"), "p").agg(F.min(fact_text(F.col("s"), F.col("p"), F.col("o"))).alias("evidence"))


def domain_trace(facts: DataFrame, t: Terminology) -> DataFrame:
    """domain(p, C) with a trace of (i, p): i is a C."""
    rule = _small(sorted(set(t.domain)), facts.sparkSession, "dp string, c string")
    j = traces(facts, t, sorted({p for p, _ in t.domain})).join(rule, F.col("p") == F.col("dp"))
    why, d = F.concat_ws(" and ", "evidence"), F.concat(F.lit("domain("), "dp", F.lit(") = "), "c")
    return _path(j, F.col("i"), F.lit("rdf:type"), F.col("c"), "domain_trace", "DOMAIN_RANGE", [_axiom("ObjectPropertyAssertion", why), _axiom("ObjectPropertyDomain", d)], [why, d])


def shortest_chains(t: Terminology, equivalents: bool) -> list[tuple[str, str, list[str]]]:
    """(lowest, highest, classes on the way): a shortest upward way of every pair of named classes, the first by name."""
    up: dict[str, set[str]] = {}
    for a, b in [*t.sub_class, *(x for c, d in t.equivalent_class if equivalents for x in ((c, d), (d, c)))]:
        up.setdefault(a, set()).add(b)
    out = []
    for start in sorted(up):
        ways, level = {start: [start]}, [start]
        while level:
            nxt = {}
            for a in sorted(level, key=lambda x: ways[x]):
                for b in sorted(up.get(a, ())):
                    if b not in ways and b not in nxt:
                        nxt[b] = [*ways[a], b]
            ways |= nxt
            level = list(nxt)
        out += [(start, b, w) for b, w in sorted(ways.items()) if b != start]
    return out


def class_trace(types: DataFrame, t: Terminology, equivalents: bool = False) -> DataFrame:
    """A type T of i and a shortest way from T up to C; with equivalents, also over named equivalent classes, for asserted
    and inferred types alike (pass the types to start from). One path for each T and C."""
    rule = [(a, b, [f"{x} rdfs:subClassOf {y}" for x, y in zip(w, w[1:], strict=False)]) for a, b, w in shortest_chains(t, equivalents)]
    j = types.dropna().distinct().join(_small(rule, types.sparkSession, "x string, target string, steps array<string>"), F.col("c") == F.col("x"))
    first = fact_text(F.col("i"), F.lit("rdf:type"), F.col("x"))
    just = F.concat(F.array(first), F.col("steps"))
    axioms = F.concat(F.array(_axiom("ClassAssertion", first)), F.transform("steps", lambda s: F.struct(F.lit("SubClassOf").alias("kind"), s.alias("text"))))
    return j.select(
        F.col("i").alias("s"), F.lit("rdf:type").alias("p"), F.col("target").alias("o"), F.lit("hierarchical" if equivalents else "class_trace").alias("finder"), F.lit("SUBSUMPTION").alias("type"),
        axioms.alias("axioms"), just.alias("justifications"), F.concat_ws(" and ", just).alias("description"), F.size(axioms).alias("complexity"),
    )


def _members(types: DataFrame, asserted: DataFrame) -> DataFrame:
    """(i2, c1, told): every type, and whether it is asserted."""
    told = asserted.select("i", "c").dropna().distinct().withColumn("told", F.lit(True))
    return types.select("i", "c").dropna().distinct().join(told, ["i", "c"], "left").select(F.col("i").alias("i2"), F.col("c").alias("c1"), F.coalesce("told", F.lit(False)).alias("told"))


def existential_asserted(facts: DataFrame, asserted_facts: DataFrame, types: DataFrame, asserted_types: DataFrame, t: Terminology) -> DataFrame:
    """some p.D with a value in D, where the fact or the value's type is asserted; the smallest such value."""
    rule = _small(t.some, facts.sparkSession, "sp string, d string, target string")
    told = _told(asserted_facts).withColumn("told_fact", F.lit(True))
    used = _told(facts).join(rule, F.col("p") == F.col("sp")).join(told, ["s", "p", "o"], "left")
    j = used.join(_members(types, asserted_types), (F.col("o") == F.col("i2")) & (F.col("d") == F.col("c1"))).where(F.col("told_fact").isNotNull() | F.col("told"))
    j = j.groupBy("s", "p", "d", "target").agg(F.min("o").alias("v"))
    a, b, r = fact_text(F.col("s"), F.col("p"), F.col("v")), fact_text(F.col("v"), F.lit("rdf:type"), F.col("d")), F.concat("p", F.lit(" someValuesFrom "), "d")
    return _path(j, F.col("s"), F.lit("rdf:type"), F.col("target"), "existential_asserted", "EXISTENTIAL", [_axiom("ObjectPropertyAssertion", a), _axiom("ClassAssertion", b), _axiom("ClassExpression", r)], [a, b, r])


def intersection_asserted(types: DataFrame, asserted_types: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """(C, named parts): all parts hold, two at least, and one of them is asserted."""
    rule = [(c, d, len(set(parts))) for c, parts in rules for d in sorted(set(parts))]
    j = _members(types, asserted_types).join(_small(rule, types.sparkSession, "target string, x string, n int"), F.col("c1") == F.col("x"))
    j = j.groupBy("i2", "target", "n").agg(F.sort_array(F.collect_set("x")).alias("xs"), F.max("told").alias("told")).where("size(xs) = n and n >= 2 and told")
    parts, r = F.concat_ws(" and ", F.transform("xs", lambda x: fact_text(F.col("i2"), F.lit("rdf:type"), x))), F.concat("target", F.lit(" intersectionOf "), F.concat_ws(", ", "xs"))
    return _path(j, F.col("i2"), F.lit("rdf:type"), F.col("target"), "intersection_asserted", "INTERSECTION", [_axiom("ClassAssertion", parts), _axiom("ClassExpression", r)], [parts, r])


def universal_vacuous(individuals: DataFrame, facts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(C, p, D): individuals(i) without any value of p are in C for want of a counterexample (a closed-world reading)."""
    rule = _small(rules, facts.sparkSession, "target string, up string, d string")
    some = _told(facts).where(F.col("p").isin(sorted({p for _, p, _ in rules}))).select(F.col("s").alias("i"), F.col("p").alias("up")).distinct()
    each = individuals.select("i").dropna().distinct().crossJoin(F.broadcast(rule))  # rows times the few rules
    j = each.join(some, ["i", "up"], "left_anti")
    a, r = F.concat("i", F.lit(" has no value of "), "up"), F.concat("up", F.lit(" allValuesFrom "), "d")
    return _path(j, F.col("i"), F.lit("rdf:type"), F.col("target"), "universal_vacuous", "UNIVERSAL", [_axiom("ObjectPropertyAssertion", a), _axiom("ClassExpression", r)], [a, r])


def combination(facts: DataFrame, types: DataFrame, rules: list[tuple[str, list]]) -> DataFrame:
    """(C, parts): an intersection of class names and (p, D) existentials of which two parts at least are satisfied, one an
    existential; other kinds of parts are left aside."""
    spark = facts.sparkSession
    named = [(c, x) for c, parts in rules for x in parts if isinstance(x, str)]
    some = [(c, p, d) for c, parts in rules for x in parts if not isinstance(x, str) for p, d in [x]]
    member = types.select("i", "c").dropna().distinct()
    one = member.join(_small(named, spark, "target string, x string"), F.col("c") == F.col("x")).select("i", "target", F.lit(0).alias("k"), fact_text(F.col("i"), F.lit("rdf:type"), F.col("x")).alias("t"))
    pair = _told(facts).join(_small(some, spark, "target string, sp string, d string"), F.col("p") == F.col("sp"))
    pair = pair.join(member.select(F.col("i").alias("i2"), F.col("c").alias("c1")), (F.col("o") == F.col("i2")) & (F.col("d") == F.col("c1"))).groupBy("s", "p", "d", "target").agg(F.min("o").alias("v"))
    two = pair.select(F.col("s").alias("i"), "target", F.lit(1).alias("k"), F.concat(fact_text(F.col("s"), F.col("p"), F.col("v")), F.lit(" with "), fact_text(F.col("v"), F.lit("rdf:type"), F.col("d"))).alias("t"))
    j = one.unionByName(two).groupBy("i", "target").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("parts")).where("size(parts) >= 2 and element_at(parts, -1).k = 1")
    parts = F.concat_ws(" and ", F.transform("parts", lambda x: x["t"]))
    return _path(j, F.col("i"), F.lit("rdf:type"), F.col("target"), "combination", "INTERSECTION", [_axiom("ClassAssertion", parts), _axiom("ClassExpression", F.col("target"))], [parts, F.col("target")])


def explained(candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """Candidate facts (s, p, o) with at least one path: n_paths, and the chosen path's justifications (the fewest axioms,
    then the first by text)."""
    best = paths.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n_paths"), F.min(F.struct("complexity", "description")).alias("b"))
    return candidates.select("s", "p", "o").distinct().join(best, ["s", "p", "o"]).select("s", "p", "o", "n_paths", F.col("b.complexity").alias("complexity"), F.col("b.description").alias("description"))


def entailed(statements: DataFrame, closed: DataFrame) -> DataFrame:
    """statements(s, p, o) with `holds`: whether the closed facts contain them."""
    known = closed.select("s", "p", "o").distinct().withColumn("_known", F.lit(True))
    return statements.join(known, ["s", "p", "o"], "left").withColumn("holds", F.col("_known").isNotNull()).drop("_known")


def format_axiom(kind: Column, args: Column) -> Column:
    """Readable text of an axiom of short names args. The forms are fixed values."""
    a = lambda k: F.try_element_at(args, F.lit(k))
    called = F.concat(kind, F.lit("("), a(1), F.lit(")"))
    return (
        F.when(kind == "ClassAssertion", F.concat(a(1), F.lit(" rdf:type "), a(2)))
        .when(kind == "ObjectPropertyAssertion", F.concat(a(1), F.lit(" "), a(2), F.lit(" "), a(3)))
        .when(kind == "SubClassOf", F.concat(a(1), F.lit(" rdfs:subClassOf "), a(2)))
        .when(kind == "EquivalentClasses", F.array_join(args, " owl:equivalentClass "))
        .when(kind == "ObjectPropertyDomain", F.concat(F.lit("domain("), a(1), F.lit(") = "), a(2)))
        .when(kind == "ObjectPropertyRange", F.concat(F.lit("range("), a(1), F.lit(") = "), a(2)))
        .when(kind == "SubObjectPropertyOf", F.concat(a(1), F.lit(" rdfs:subPropertyOf "), a(2)))
        .when(kind.isin("TransitiveObjectProperty", "SymmetricObjectProperty", "FunctionalObjectProperty"), called)
        .when(kind == "InverseObjectProperties", F.array_join(args, " owl:inverseOf "))
        .otherwise(F.concat(kind, F.lit("("), F.array_join(args, " "), F.lit(")")))
    )
