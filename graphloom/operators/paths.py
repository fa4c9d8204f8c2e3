"""Explanation-path finders: each is a join of (entailed) facts or types with small terminology tables.

A path row: (s, p, o, finder, type, axioms array<struct<kind, text>>, justifications array<string>, description,
complexity). Where several witnesses would do, the smallest by name is taken, so results don't depend on row order.
Terminology sides are broadcast (their size is checked); fact-fact joins are hash or sort-merge joins on their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .closure import Terminology, _small

_AXIOM = "struct<kind:string,text:string>"


def fact_text(s: Column, p: Column, o: Column) -> Column:
    return F.concat(s, F.lit(" "), p, F.lit(" "), o)  # null where any of them is, never another fact's text


def _axiom(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def _path(df: DataFrame, s: Column, p: Column, o: Column, finder: str, kind: str, axioms: list[Column], justifications: list[Column]) -> DataFrame:
    just = F.array(*justifications)
    return df.select(
        s.alias("s"), p.alias("p"), o.alias("o"), F.lit(finder).alias("finder"), F.lit(kind).alias("type"),
        F.array(*axioms).alias("axioms"), just.alias("justifications"), F.concat_ws(" and ", just).alias("description"), F.lit(len(axioms)).alias("complexity"),
    )


def direct(asserted: DataFrame) -> DataFrame:
    t = fact_text(F.col("s"), F.col("p"), F.col("o"))
    return _path(asserted, F.col("s"), F.col("p"), F.col("o"), "direct", "DIRECT_ASSERTION", [_axiom("ObjectPropertyAssertion", t)], [t])


def direct_type(types: DataFrame) -> DataFrame:
    t = fact_text(F.col("i"), F.lit("rdf:type"), F.col("c"))
    return _path(types, F.col("i"), F.lit("rdf:type"), F.col("c"), "direct_type", "DIRECT_ASSERTION", [_axiom("ClassAssertion", t)], [F.concat(t, F.lit(" (direct assertion)"))])


def sub_property(facts: DataFrame, t: Terminology) -> DataFrame:
    rule = _small(t.sub_property, facts.sparkSession, "q string, sup string")
    j = facts.join(rule, F.col("p") == F.col("q"))
    a, b = fact_text(F.col("s"), F.col("q"), F.col("o")), F.concat_ws(" ", "q", F.lit("rdfs:subPropertyOf"), "sup")
    return _path(j, F.col("s"), F.col("sup"), F.col("o"), "sub_property", "SUBPROPERTY", [_axiom("ObjectPropertyAssertion", a), _axiom("SubObjectPropertyOf", b)], [a, b])


def symmetric(facts: DataFrame, t: Terminology) -> DataFrame:
    j = facts.where(F.col("p").isin(t.symmetric))
    a, b = fact_text(F.col("s"), F.col("p"), F.col("o")), F.concat(F.lit("SymmetricObjectProperty("), "p", F.lit(")"))
    return _path(j, F.col("o"), F.col("p"), F.col("s"), "symmetric", "SYMMETRIC_PROPERTY", [_axiom("ObjectPropertyAssertion", a), _axiom("SymmetricObjectProperty", b)], [a, b])


def inverse(facts: DataFrame, t: Terminology) -> DataFrame:
    both = sorted({x for p, q in t.inverse for x in ((p, q), (q, p))})
    j = facts.join(_small(both, facts.sparkSession, "target string, q string"), F.col("p") == F.col("q"))
    a, b = fact_text(F.col("s"), F.col("q"), F.col("o")), F.concat_ws(" ", "target", F.lit("owl:inverseOf"), "q")
    return _path(j, F.col("o"), F.col("target"), F.col("s"), "inverse", "INVERSE_PROPERTY", [_axiom("ObjectPropertyAssertion", a), _axiom("InverseObjectProperties", b)], [a, b])


def _two_steps(facts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(a, p1, m, p2, b, q): smallest middle m of every two-step connection."""
    rule = _small(rules, facts.sparkSession, "p1 string, p2 string, q string")
    left = facts.join(rule, F.col("p") == F.col("p1")).select(F.col("s").alias("a"), "p1", F.col("o").alias("m"), "p2", "q")
    right = facts.where(F.col("p").isin(sorted({r[1] for r in rules}))).select(F.col("s").alias("m2"), F.col("p").alias("pp"), F.col("o").alias("b"))
    j = left.join(right, (F.col("m") == F.col("m2")) & (F.col("p2") == F.col("pp")))
    return j.groupBy("a", "p1", "p2", "b", "q").agg(F.min("m").alias("m"))


def transitive(facts: DataFrame, t: Terminology) -> DataFrame:
    j = _two_steps(facts, [(p, p, p) for p in t.transitive]).where("m <> b and m <> a")
    x, y, z = fact_text(F.col("a"), F.col("q"), F.col("m")), fact_text(F.col("m"), F.col("q"), F.col("b")), F.concat(F.lit("TransitiveObjectProperty("), "q", F.lit(")"))
    return _path(j, F.col("a"), F.col("q"), F.col("b"), "transitive", "TRANSITIVE_PROPERTY", [_axiom("ObjectPropertyAssertion", x), _axiom("ObjectPropertyAssertion", y), _axiom("TransitiveObjectProperty", z)], [x, y, z])


def _along(facts: DataFrame, steps: list[str]) -> DataFrame:
    """(a, b, nodes): the ends of facts of the named properties one after the other, with the least nodes between; every step
    keeps one way for a pair of ends, so ways don't multiply."""
    first = facts.where(F.col("p") == steps[0])
    out = first.select(F.col("s").alias("a"), F.col("o").alias("b"), F.array("s", "o").alias("nodes")).distinct()
    for p in steps[1:]:
        step = facts.where(F.col("p") == p).select(F.col("s").alias("b0"), F.col("o").alias("b1"))
        out = out.join(step, F.col("b") == F.col("b0")).select("a", F.col("b1").alias("b"), F.concat("nodes", F.array("b1")).alias("nodes"))
        out = out.groupBy("a", "b").agg(F.min("nodes").alias("nodes"))
    return out


def _long_chain(ways: DataFrame, steps: list[str], q: str, finder: str, o: Column, p: Column, more: list[tuple[str, Column]]) -> DataFrame:
    facts = [fact_text(F.col("nodes")[k], F.lit(x), F.col("nodes")[k + 1]) for k, x in enumerate(steps)]
    rest = [("SubPropertyChainOf", F.lit(f"{' ∘ '.join(steps)} → {q}")), *more]
    axioms = [*(_axiom("ObjectPropertyAssertion", x) for x in facts), *(_axiom(k, x) for k, x in rest)]
    return _path(ways, F.col("a"), p, o, finder, "PROPERTY_CHAIN", axioms, [*facts, *(x for _, x in rest)])


def chain(facts: DataFrame, t: Terminology) -> DataFrame:
    """Facts that a chain gives, of any length, with the facts along the least way."""
    j = _two_steps(facts, [x for x in t.chains if len(x) == 3])
    x, y = fact_text(F.col("a"), F.col("p1"), F.col("m")), fact_text(F.col("m"), F.col("p2"), F.col("b"))
    z = F.concat("p1", F.lit(" ∘ "), "p2", F.lit(" → "), "q")
    out = _path(j, F.col("a"), F.col("q"), F.col("b"), "chain", "PROPERTY_CHAIN", [_axiom("ObjectPropertyAssertion", x), _axiom("ObjectPropertyAssertion", y), _axiom("SubPropertyChainOf", z)], [x, y, z])
    for *steps, q in (x for x in t.chains if len(x) > 3):
        out = out.unionByName(_long_chain(_along(facts, steps), steps, q, "chain", F.col("b"), F.lit(q), []))
    return out


def domain(facts: DataFrame, t: Terminology) -> DataFrame:
    j = facts.join(_small(t.domain, facts.sparkSession, "dp string, c string"), F.col("p") == F.col("dp")).groupBy("s", "p", "c").agg(F.min("o").alias("v"))
    a, b = fact_text(F.col("s"), F.col("p"), F.col("v")), F.concat(F.lit("domain("), "p", F.lit(") = "), "c")
    return _path(j, F.col("s"), F.lit("rdf:type"), F.col("c"), "domain", "DOMAIN_RANGE", [_axiom("ObjectPropertyAssertion", a), _axiom("ObjectPropertyDomain", b)], [a, b])


def range_(facts: DataFrame, t: Terminology, every: bool = False) -> DataFrame:
    """One path a range axiom (smallest subject), or one for every subject."""
    j = facts.join(_small(t.range, facts.sparkSession, "rp string, c string"), F.col("p") == F.col("rp"))
    j = j.select("s", "p", "o", "c") if every else j.groupBy("o", "p", "c").agg(F.min("s").alias("s"))
    a, b = fact_text(F.col("s"), F.col("p"), F.col("o")), F.concat(F.lit("range("), "p", F.lit(") = "), "c")
    return _path(j, F.col("o"), F.lit("rdf:type"), F.col("c"), "range", "DOMAIN_RANGE", [_axiom("ObjectPropertyAssertion", a), _axiom("ObjectPropertyRange", b)], [a, b])


def sub_class(types: DataFrame, t: Terminology) -> DataFrame:
    j = types.join(_small(t.sub_class, types.sparkSession, "x string, sup string"), F.col("c") == F.col("x"))
    a, b = fact_text(F.col("i"), F.lit("rdf:type"), F.col("x")), F.concat_ws(" ", "x", F.lit("SubClassOf"), "sup")
    return _path(j, F.col("i"), F.lit("rdf:type"), F.col("sup"), "sub_class", "SUBSUMPTION", [_axiom("ClassAssertion", a), _axiom("SubClassOf", b)], [a, b])


def equivalent_class(types: DataFrame, t: Terminology) -> DataFrame:
    both = sorted({x for c, d in t.equivalent_class for x in ((c, d), (d, c))})
    j = types.join(_small(both, types.sparkSession, "target string, x string"), F.col("c") == F.col("x"))
    a, b = fact_text(F.col("i"), F.lit("rdf:type"), F.col("x")), F.concat_ws(" ", "target", F.lit("owl:equivalentClass"), "x")
    return _path(j, F.col("i"), F.lit("rdf:type"), F.col("target"), "equivalent_class", "EQUIVALENT_CLASS", [_axiom("ClassAssertion", a), _axiom("EquivalentClasses", b)], [a, b])


def existential(facts: DataFrame, types: DataFrame, t: Terminology) -> DataFrame:
    j = facts.join(_small(t.some, facts.sparkSession, "sp string, d string, c2 string"), F.col("p") == F.col("sp"))
    member = types.select(F.col("i").alias("i2"), F.col("c").alias("c1"))
    j = j.join(member, (F.col("o") == F.col("i2")) & (F.col("d") == F.col("c1"))).groupBy("s", "p", "d", "c2").agg(F.min("o").alias("v"))
    a, b, r = fact_text(F.col("s"), F.col("p"), F.col("v")), fact_text(F.col("v"), F.lit("rdf:type"), F.col("d")), F.concat("p", F.lit(" someValuesFrom "), "d")
    return _path(j, F.col("s"), F.lit("rdf:type"), F.col("c2"), "existential", "EXISTENTIAL", [_axiom("ObjectPropertyAssertion", a), _axiom("ClassAssertion", b), _axiom("ClassExpression", r)], [a, b, r])


def union(types: DataFrame, t: Terminology) -> DataFrame:
    rule = [(c, k, d) for c, parts in t.unions for k, d in enumerate(parts)]
    j = types.join(_small(rule, types.sparkSession, "target string, k int, x string"), F.col("c") == F.col("x")).groupBy("i", "target").agg(F.min_by("x", "k").alias("x"))
    a, b = fact_text(F.col("i"), F.lit("rdf:type"), F.col("x")), F.concat("target", F.lit(" unionOf "), "x")
    return _path(j, F.col("i"), F.lit("rdf:type"), F.col("target"), "union", "UNION", [_axiom("ClassAssertion", a), _axiom("ClassExpression", b)], [a, b])


def intersection(types: DataFrame, t: Terminology) -> DataFrame:
    """All named operands hold, two at least; operands that are expressions are left aside, as published paths do."""
    rule = [(c, d, len([x for x in parts if isinstance(x, str)])) for c, parts in t.intersections for d in parts if isinstance(d, str)]
    j = types.join(_small(rule, types.sparkSession, "target string, x string, n int"), F.col("c") == F.col("x"))
    j = j.groupBy("i", "target", "n").agg(F.sort_array(F.collect_set("x")).alias("xs")).where("size(xs) = n and n >= 2")
    each = F.transform("xs", lambda x: F.concat_ws(" ", F.col("i"), F.lit("rdf:type"), x))
    rule_text = F.concat("target", F.lit(" intersectionOf "), F.concat_ws(", ", "xs"))
    axioms = F.concat(F.transform(each, lambda x: F.struct(F.lit("ClassAssertion").alias("kind"), x.alias("text"))), F.array(_axiom("ClassExpression", rule_text)))
    just = F.concat(each, F.array(rule_text))
    return j.select(F.col("i").alias("s"), F.lit("rdf:type").alias("p"), F.col("target").alias("o"), F.lit("intersection").alias("finder"), F.lit("INTERSECTION").alias("type"), axioms.alias("axioms"), just.alias("justifications"), F.concat_ws(" and ", just).alias("description"), F.size(axioms).alias("complexity"))


def universal(facts: DataFrame, types: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(C, p, D): all p-values of s are known members of D, one at least (a closed-world reading)."""
    j = facts.join(_small(rules, facts.sparkSession, "target string, up string, d string"), F.col("p") == F.col("up"))
    member = types.select(F.col("i").alias("i2"), F.col("c").alias("c1"))
    j = j.join(member, (F.col("o") == F.col("i2")) & (F.col("d") == F.col("c1")), "left").groupBy("s", "p", "target", "d").agg(F.count(F.lit(1)).alias("n"), F.count("i2").alias("m"), F.min("o").alias("v")).where("n = m")
    a, r = fact_text(F.col("s"), F.col("p"), F.col("v")), F.concat("p", F.lit(" allValuesFrom "), "d")
    return _path(j, F.col("s"), F.lit("rdf:type"), F.col("target"), "universal", "UNIVERSAL", [_axiom("ObjectPropertyAssertion", a), _axiom("ClassExpression", r)], [a, r])


def _domain_after(facts: DataFrame, rows: list[tuple], schema: str, on: str):
    return facts.join(_small(rows, facts.sparkSession, schema), F.col("p") == F.col(on))


def inverse_domain(facts: DataFrame, t: Terminology) -> DataFrame:
    """domain(p, C), inverse(p, q), q(x, i): i is a C, for every x."""
    inv = {x for p, q in t.inverse for x in ((p, q), (q, p))}
    rule = sorted({(q, p, c) for p, c in t.domain for p2, q in inv if p2 == p})
    j = _domain_after(facts, rule, "q string, dp string, c string", "q")
    a, b, d = fact_text(F.col("s"), F.col("q"), F.col("o")), F.concat_ws(" ", "dp", F.lit("owl:inverseOf"), "q"), F.concat(F.lit("domain("), "dp", F.lit(") = "), "c")
    return _path(j, F.col("o"), F.lit("rdf:type"), F.col("c"), "inverse_domain", "INVERSE_PROPERTY", [_axiom("ObjectPropertyAssertion", a), _axiom("InverseObjectProperties", b), _axiom("ObjectPropertyDomain", d)], [a, b, d])


def sub_property_domain(facts: DataFrame, t: Terminology) -> DataFrame:
    rule = sorted({(q, p, c) for q, p in t.sub_property for p2, c in t.domain if p2 == p})
    j = _domain_after(facts, rule, "q string, dp string, c string", "q").groupBy("s", "q", "dp", "c").agg(F.min("o").alias("v"))
    a, b, d = fact_text(F.col("s"), F.col("q"), F.col("v")), F.concat_ws(" ", "q", F.lit("rdfs:subPropertyOf"), "dp"), F.concat(F.lit("domain("), "dp", F.lit(") = "), "c")
    return _path(j, F.col("s"), F.lit("rdf:type"), F.col("c"), "sub_property_domain", "SUBPROPERTY", [_axiom("ObjectPropertyAssertion", a), _axiom("SubObjectPropertyOf", b), _axiom("ObjectPropertyDomain", d)], [a, b, d])


def symmetric_domain(facts: DataFrame, t: Terminology) -> DataFrame:
    rule = sorted({(p, c) for p, c in t.domain if p in t.symmetric})
    j = _domain_after(facts, rule, "dp string, c string", "dp").where("s <> o").groupBy("o", "dp", "c").agg(F.min("s").alias("x"))
    a, b, d = fact_text(F.col("x"), F.col("dp"), F.col("o")), F.concat(F.lit("SymmetricObjectProperty("), "dp", F.lit(")")), F.concat(F.lit("domain("), "dp", F.lit(") = "), "c")
    return _path(j, F.col("o"), F.lit("rdf:type"), F.col("c"), "symmetric_domain", "SYMMETRIC_PROPERTY", [_axiom("ObjectPropertyAssertion", a), _axiom("SymmetricObjectProperty", b), _axiom("ObjectPropertyDomain", d)], [a, b, d])


def chain_domain(facts: DataFrame, t: Terminology) -> DataFrame:
    """Members of a domain through a chain into its property; of chains of over two steps the least way of a subject."""
    rule = [r for r in t.chains if r[-1] in {p for p, _ in t.domain}]
    j = _two_steps(facts, [r for r in rule if len(r) == 3]).join(_small(t.domain, facts.sparkSession, "dp string, c string"), F.col("q") == F.col("dp")).groupBy("a", "p1", "p2", "q", "c", "m").agg(F.min("b").alias("b"))
    x, y = fact_text(F.col("a"), F.col("p1"), F.col("m")), fact_text(F.col("m"), F.col("p2"), F.col("b"))
    z, d = F.concat("p1", F.lit(" ∘ "), "p2", F.lit(" → "), "q"), F.concat(F.lit("domain("), "q", F.lit(") = "), "c")
    out = _path(j, F.col("a"), F.lit("rdf:type"), F.col("c"), "chain_domain", "PROPERTY_CHAIN", [_axiom("ObjectPropertyAssertion", x), _axiom("ObjectPropertyAssertion", y), _axiom("SubPropertyChainOf", z), _axiom("ObjectPropertyDomain", d)], [x, y, z, d])
    for *steps, q in (r for r in rule if len(r) > 3):
        ways = _along(facts, steps).groupBy("a").agg(F.min("nodes").alias("nodes"))
        for c in (c for p, c in t.domain if p == q):
            out = out.unionByName(_long_chain(ways, steps, q, "chain_domain", F.lit(c), F.lit("rdf:type"), [("ObjectPropertyDomain", F.lit(f"domain({q}) = {c}"))]))
    return out


def functional_range(facts: DataFrame, t: Terminology) -> DataFrame:
    """Members of a functional property's range: the object, which is sound (published paths name the subject)."""
    rule = sorted({(p, c) for p, c in t.range if p in t.functional})
    j = _domain_after(facts, rule, "rp string, c string", "rp").groupBy("o", "rp", "c").agg(F.min("s").alias("x"))
    a, b, d = fact_text(F.col("x"), F.col("rp"), F.col("o")), F.concat(F.lit("FunctionalObjectProperty("), "rp", F.lit(")")), F.concat(F.lit("range("), "rp", F.lit(") = "), "c")
    return _path(j, F.col("o"), F.lit("rdf:type"), F.col("c"), "functional_range", "FUNCTIONAL_PROPERTY", [_axiom("ObjectPropertyAssertion", a), _axiom("FunctionalObjectProperty", b), _axiom("ObjectPropertyRange", d)], [a, b, d])


def class_chains(t: Terminology, depth: int = 10, equivalents: bool = True) -> list[tuple[str, str, list[str]]]:
    """(lowest, highest, classes on the way) of every loop-free upward path of the named classes; terminology only."""
    up: dict[str, list[str]] = {}
    for a, b in [*t.sub_class, *(x for c, d in t.equivalent_class if equivalents for x in ((c, d), (d, c)))]:
        up.setdefault(a, []).append(b)
    out = []
    for start in up:
        todo = [[start]]
        while todo:
            way = todo.pop()
            if len(way) > depth:
                continue
            for b in sorted(set(up.get(way[-1], []))):
                if b not in way:
                    out.append((start, b, [*way, b]))
                    todo.append([*way, b])
    return sorted(out)


def sub_class_paths(asserted_types: DataFrame, t: Terminology, depth: int = 10) -> DataFrame:
    """Every upward path from an asserted type: one row a path."""
    rule = [(a, b, " ⊑ ".join(w), len(w)) for a, b, w in class_chains(t, depth)]
    j = asserted_types.join(_small(rule, asserted_types.sparkSession, "x string, target string, way string, n int"), F.col("c") == F.col("x"))
    a = fact_text(F.col("i"), F.lit("rdf:type"), F.col("x"))
    out = _path(j, F.col("i"), F.lit("rdf:type"), F.col("target"), "sub_class_paths", "SUBSUMPTION", [_axiom("ClassAssertion", a), _axiom("SubClassOf", F.col("way"))], [a, F.concat(F.lit("subClassOf path "), "way")])
    return out


def deduplicated(paths: DataFrame) -> DataFrame:
    """One path for each conclusion and signature (type with sorted axioms): the longest description, then more axioms,
    then the first by text."""
    sign = F.concat_ws("¦", "type", F.concat_ws("¦", F.sort_array(F.transform("axioms", lambda a: F.concat(a["kind"], F.lit(":"), a["text"])))))
    best = Window.partitionBy("s", "p", "o", "sign").orderBy(F.length("description").desc(), F.size("axioms").desc(), "description")
    return paths.withColumn("sign", sign).withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "sign")


def tagged(paths: DataFrame) -> DataFrame:
    return names.with_tag(paths)
