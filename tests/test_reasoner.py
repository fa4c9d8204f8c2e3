"""Closure with equality, nested expressions, long chains and proofs, against naive evaluation in Python."""

import itertools
import random

import pytest

from graphloom.operators import closure, equality, paths, provenance, reasoner, rules
from graphloom.plans import reason_queries
from graphloom.sources import rdf

T = closure.Terminology
THING = "owl:Thing"
F4, TY = "g string, s string, p string, o string", "g string, i string, c string"


def frames(spark, facts, types):
    return spark.createDataFrame(facts, F4), spark.createDataFrame(types, TY)


def holds(e, x, facts, types, nodes):
    """Whether x is in expression e, by what is known."""
    if isinstance(e, str):
        return e == THING or (x, e) in types
    kind, *rest = e
    if kind in ("and", "or"):
        return (all if kind == "and" else any)(holds(y, x, facts, types, nodes) for y in rest)
    if kind == "one":
        return x in rest
    p = rest[1] if kind in ("min", "max", "exact") else rest[0]
    out = {(o if isinstance(p, str) else s) for s, q, o in facts if q == (p if isinstance(p, str) else p[1]) and (s if isinstance(p, str) else o) == x}
    if kind == "value":
        return rest[1] in out
    if kind == "self":
        return x in out
    filler = rest[1] if kind == "some" else rest[2]
    return any(holds(filler, y, facts, types, nodes) for y in out)


def naive(facts, types, t):
    """Facts, types and the representative of every name, by trying everything until nothing changes. No anonymous successors."""
    facts, types, rep = set(facts), set(types), {}
    while True:
        before = (set(facts), set(types))
        nodes = {x for s, _, o in facts for x in (s, o)} | {i for i, _ in types}
        add = set()
        for s, p, o in facts:
            add |= {(s, q, o) for a, q in t.sub_property if a == p}
            for a, b in t.inverse:
                add |= {(o, b, s)} if p == a else set()
                add |= {(o, a, s)} if p == b else set()
            add |= {(o, p, s)} if p in t.symmetric else set()
            types |= {(s, c) for q, c in t.domain if q == p} | {(o, c) for q, c in t.range if q == p}
        for *steps, q in [*t.chains, *((p, p, p) for p in t.transitive)]:
            ends = {(s, o) for s, p, o in facts if p == steps[0]}
            for r in steps[1:]:
                ends = {(a, o) for a, m in ends for s, p, o in facts if p == r and s == m}
            add |= {(a, q, b) for a, b in ends}
        facts |= add
        pairs = {(s, o) for s, p, o in facts if p == "owl:sameAs"}
        left = [*((c, d) for c, d in t.sub_class), *t.expressions]
        for c, d in left:
            for x in nodes:
                if holds(c, x, facts, types, nodes):
                    conclude(d, x, facts, types, pairs, t)
        for k, (a, b) in itertools.product(t.functional, itertools.combinations(list(facts), 2)):
            pairs |= {(a[2], b[2])} if a[:2] == b[:2] and a[1] == k else set()
        for k, (a, b) in itertools.product(t.inverse_functional, itertools.combinations(list(facts), 2)):
            pairs |= {(a[0], b[0])} if a[1:] == b[1:] and a[1] == k else set()
        for a, b in pairs:
            a, b = find(rep, a), find(rep, b)
            if a != b:
                rep[max(a, b)] = min(a, b)
        facts = {(find(rep, s), p, find(rep, o)) for s, p, o in facts}
        facts = {f for f in facts if f[1] != "owl:sameAs" or f[0] != f[2]}
        types = {(find(rep, i), c) for i, c in types}
        if (facts, types) == before:
            return facts, types, {x: find(rep, x) for x in rep}


def find(rep, x):
    while x in rep:
        x = rep[x]
    return x


def conclude(e, x, facts, types, pairs, t):
    if isinstance(e, str):
        types.add((x, e))
    elif e[0] == "and":
        for y in e[1:]:
            conclude(y, x, facts, types, pairs, t)
    elif e[0] == "value":
        facts.add((x, e[1], e[2]))
    elif e[0] == "self":
        facts.add((x, e[1], x))
    elif e[0] == "one":
        pairs.add((x, e[1]))
    elif e[0] == "only":
        for s, p, o in list(facts):
            if s == x and p == e[1]:
                conclude(e[2], o, facts, types, pairs, t)
    elif e[0] == "max":
        values = [o for s, p, o in facts if s == x and p == e[2] and holds(e[3], o, facts, types, ())]
        pairs |= set(itertools.combinations(values, 2))


BIG = T(
    sub_property=[("p", "q")], inverse=[("r", "rOf")], symmetric=["y"], transitive=["q"], functional=["f"], inverse_functional=["b"],
    chains=[("p", "r", "p", "y", "long"), ("p", "r", "short"), ("p", "r", "p", "middle")], domain=[("f", "A")], range=[("r", "B")], sub_class=[("A", "C")],
    expressions=[
        (("and", "A", "B", ("some", "p", ("or", "D", ("some", "r", ("and", "B", ("value", "p", "n0")))))), "Deep"), ("Deep", ("value", "y", "n1")), (("some", ("inverse", "p"), "C"), "Under"),
        ("D", ("only", "r", ("and", "E", ("only", "p", "Far")))), (("self", "q"), "Loop"), ("Loop", ("self", "y")), ("E", ("max", 1, "r", "B")), (("one", "n2", "n3"), "D"), ("Single", ("one", "n4")), (("some", "long", THING), "Single"),
    ],
)


def test_random_graphs(spark):
    random.seed(11)
    facts, types, want_f, want_t, want_s = [], [], set(), set(), set()
    for k in range(24):
        g = f"g{k}"
        f = {(f"n{random.randrange(9)}", random.choice(["p", "p", "r", "y", "f", "b", "q"]), f"n{random.randrange(9)}") for _ in range(random.randint(0, 9))}
        f |= {("n7", "owl:sameAs", "n8")} if k % 5 == 0 else set()
        c = {(f"n{random.randrange(9)}", random.choice("ABDE")) for _ in range(random.randint(0, 6))}
        facts += [(g, *x) for x in f]
        types += [(g, *x) for x in c]
        # a nominal holds of names that occur
        seen = {x for s, _, o in f for x in (s, o)} | {i for i, _ in c}
        a, b, rep = naive(f, c | {(n, "D") for n in ("n2", "n3") if n in seen}, T(**{**vars(BIG), "expressions": [e for e in BIG.expressions if e[0] != ("one", "n2", "n3")]}))
        want_f |= {(g, *x) for x in a}
        want_t |= {(g, *x) for x in b}
        want_s |= {(g, *x) for x in rep.items()}
    closed = reasoner.closure(*frames(spark, facts, types), BIG)
    assert {tuple(r) for r in closed.same.collect()} == want_s and want_s
    # a value that a rule gives, or that a class is, may be a name that occurs nowhere else: then it has no nominal types here
    assert {tuple(r) for r in closed.facts.where("NOT p LIKE 'inverse(%'").collect()} == want_f
    assert {tuple(r) for r in closed.types.collect()} == want_t


def test_anonymous_successors(spark):
    t = T(sub_property=[("p", "q")], range=[("q", "R")], transitive=["q"], exists=[("A", "p", "B")], expressions=[
        ("B", ("some", "q", ("and", "C", ("some", "r", "D")))), (("some", "q", ("and", "R", "C")), "Near"), (("some", "q", ("some", "r", THING)), "Far"), ("Far", ("value", "s", "v")),
        ("X", ("exact", 1, "f", "Y")), (("some", "f", "Y"), "HasY")], functional=["f"])
    closed = reasoner.closure(*frames(spark, [("g", "x", "f", "y")], [("g", "a", "A"), ("g", "x", "X")]), t)
    types = {(r.i, r.c) for r in closed.types.collect()}
    assert {("a", "Near"), ("a", "Far"), ("x", "HasY"), ("y", "Y")} <= types and ("a", "B") not in types
    assert ("a", "s", "v") in {(r.s, r.p, r.o) for r in closed.facts.collect()}


def test_nothing_dropped_without_an_error(spark):
    f, y = frames(spark, [], [("g", "x", "A")])
    for e in [("A", ("or", "B", "C")), (("not", "A"), "B"), ("A", ("max", 2, "p", "B")), (("only", "p", "A"), "B")]:
        t = T(sub_class=[("A", "Z")], expressions=[e])
        with pytest.raises(rules.NotUnderstood):
            reasoner.closure(f, y, t)
        assert {r.c for r in reasoner.closure(f, y, t, strict=False).types.collect()} == {"A", "Z"}
    with pytest.raises(ValueError, match="reasoner.closure"):
        closure.close_types(y, f, T(expressions=[("A", ("value", "p", "v"))]))


def test_contradictions(spark):
    t = T(expressions=[("A", ("not", "B"))], disjoint_property=[("p", "q")], inverse_functional=["p"])
    closed = reasoner.closure(*frames(spark, [("g", "x", "p", "y"), ("g", "x", "q", "y"), ("g", "z", "p", "y"), ("g", "x", "owl:differentFrom", "z")], [("g", "x", "A"), ("g", "z", "B")]), t)
    assert {(r.rule, r.x) for r in reasoner.contradictions(closed, t).collect()} == {("disjoint", "x"), ("disjoint-property", "x"), ("different", "x")}
    f = spark.createDataFrame([("g", "a", "p", "b"), ("g", "c", "p", "b"), ("g", "a", "q", "b")], F4)
    assert {r.rule for r in closure.violations(f, spark.createDataFrame([], TY), T(inverse_functional=["p"], disjoint_property=[("p", "q")])).collect()} == {"inverse-functional", "disjoint-property"}


def test_hot_representative(spark):
    star = [("g", "hub", "f", f"v{k:05d}") for k in range(3000)]
    path = [("h", f"w{k:03d}", "owl:sameAs", f"w{k + 1:03d}") for k in range(100)]
    closed = reasoner.closure(*frames(spark, star + path + [("g", "v00007", "p", "z"), (None, "a", "f", "b"), ("g", None, "f", "b")], []), T(functional=["f"]))
    same = closed.same.collect()
    assert {(r.g, r.rep) for r in same} == {("g", "v00000"), ("h", "w000")} and len(same) == 2999 + 100
    assert {tuple(r) for r in closed.facts.where("p <> 'owl:sameAs'").collect()} == {("g", "hub", "f", "v00000"), ("g", "v00000", "p", "z")}
    assert closed.all_facts().where("p = 'f'").count() == 3000


def test_components(spark):
    random.seed(3)
    pairs = [("g", f"n{random.randrange(60)}", f"n{random.randrange(60)}") for _ in range(45)] + [("h", "n1", "n0"), ("g", None, "n1"), ("g", "n5", "n5")]
    got = {(r.g, r.node): r.rep for r in equality.representatives(spark.createDataFrame(pairs, "g string, a string, b string")).collect()}
    want = {}
    for g, a, b in pairs:
        if a and b:
            for x in (a, b) if a != b else ():
                want.setdefault((g, x), x)
    for _ in want:
        for g, a, b in pairs:
            if a and b and a != b:
                want[g, a] = want[g, b] = min(want[g, a], want[g, b])
    assert got == want


def test_empty(spark):
    closed = reasoner.closure(*frames(spark, [], []), BIG)
    assert closed.facts.count() == closed.types.count() == closed.same.count() == 0
    assert provenance.proofs(*frames(spark, [], []), T(sub_class=[("A", "B")])).count() == 0


def test_chain_steps():
    assert closure.chain_steps([("a", "b", "c", "x"), ("a", "b", "y")]) == [("a", "b", "state a ∘ b"), ("state a ∘ b", "c", "x"), ("a", "b", "y")]


def test_long_chains_in_closed_facts_and_paths(spark):
    f = spark.createDataFrame([("g", "a", "p", "b"), ("g", "b", "q", "c"), ("g", "c", "r", "d")], F4)
    t = T(chains=[("p", "q", "r", "far"), ("p", "q", "near")])
    assert {(r.s, r.p, r.o) for r in closure.close_facts(f, t).collect()} - {("a", "p", "b"), ("b", "q", "c"), ("c", "r", "d")} == {("a", "near", "c"), ("a", "far", "d")}
    shown = {(r.s, r.p, r.o, r.description) for r in paths.chain(f.drop("g"), t).collect()}
    assert ("a", "far", "d", "a p b and b q c and c r d and p ∘ q ∘ r → far") in shown and len(shown) == 2


NESTED = """@prefix : <http://x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:reaches owl:propertyChainAxiom ( :in :in [ owl:inverseOf :holds ] :of ) .
:Deep owl:equivalentClass [ owl:intersectionOf ( :A [ owl:onProperty :in ; owl:someValuesFrom [ owl:unionOf ( :B [ owl:onProperty :of ; owl:hasValue :v ] ) ] ] ) ] .
:Deep rdfs:subClassOf [ owl:onProperty :only ; owl:maxCardinality 1 ] , [ owl:complementOf :Shallow ] .
:A rdfs:subClassOf [ owl:onProperty :own ; owl:hasSelf true ] .
:x a :A ; :in :y ; :only :one , :two . :y :of :v ; :in :z . :w :holds :z . :w :of :u . :x owl:sameAs :xx .
"""


def test_nested_file(spark, tmp_path):
    (tmp_path / "n.ttl").write_text(NESTED)
    triples = rdf.read(spark, str(tmp_path)).cache()
    t = rdf.terminology(triples)
    closed = reasoner.closure(*rdf.facts_and_types(triples), t)
    short = lambda df: {tuple(v.replace("http://x#", "") for v in r[1:]) for r in df.collect()}
    assert ("x", "Deep") in short(closed.types)
    assert {("x", "own", "x"), ("z", "inverse(holds)", "w"), ("x", "only", "one")} <= short(closed.facts)
    assert {("two", "one"), ("xx", "x")} == short(closed.same)
    assert ("xx", "Deep") in short(closed.all_types())


def test_reader_says_what_it_does_not_understand(spark, tmp_path):
    (tmp_path / "k.ttl").write_text(NESTED + ":A owl:hasKey ( :in ) . :B rdfs:subClassOf [ rdfs:label \"?\" ] . :q a owl:ReflexiveProperty .")
    triples = rdf.read(spark, str(tmp_path)).cache()
    with pytest.raises(rules.NotUnderstood) as e:
        rdf.terminology(triples)
    assert len(e.value.parts) == 3
    assert len(rdf.terminology(triples, strict=False).left_out) == 3


WHY = T(sub_property=[("p", "q")], inverse=[("r", "rOf")], symmetric=["y"], transitive=["q"], chains=[("p", "r", "p", "long")], domain=[("p", "A")], range=[("r", "B")], sub_class=[("A", "C"), ("B", "C")], expressions=[(("and", "A", ("some", "q", "B")), "D")])
AXIOMS = {
    "p rdfs:subPropertyOf q": ("sub_property", ("p", "q")), "r owl:inverseOf rOf": ("inverse", ("r", "rOf")), "SymmetricObjectProperty(y)": ("symmetric", "y"), "TransitiveObjectProperty(q)": ("transitive", "q"),
    "p ∘ r ∘ p → long": ("chains", ("p", "r", "p", "long")), "domain(p) = A": ("domain", ("p", "A")), "range(r) = B": ("range", ("r", "B")), "A SubClassOf C": ("sub_class", ("A", "C")), "B SubClassOf C": ("sub_class", ("B", "C")),
    "(A and (q someValuesFrom B)) SubClassOf D": ("expressions", WHY.expressions[0]),
}


def entails(statements, goal):
    t, facts, types = T(), set(), set()
    for x in statements:
        if x in AXIOMS:
            kind, value = AXIOMS[x]
            getattr(t, kind).append(value)
        else:
            s, p, o = x.split(" ")
            (types.add((s, o)) if p == "rdf:type" else facts.add((s, p, o)))
    f, c, _ = naive(facts, types, t)
    return goal in f or (goal[1] == "rdf:type" and (goal[0], goal[2]) in c)


def test_proofs(spark):
    random.seed(5)
    facts, types, want = [], [], {}
    for k in range(6):
        f = {(f"n{random.randrange(4)}", random.choice("pprqy"), f"n{random.randrange(4)}") for _ in range(5)}
        c = {(f"n{random.randrange(4)}", random.choice("AB")) for _ in range(2)}
        facts += [(f"g{k}", *x) for x in f]
        types += [(f"g{k}", *x) for x in c]
        a, b, _ = naive(f, c, WHY)
        want[f"g{k}"] = a | {(i, "rdf:type", x) for i, x in b}
    rows = provenance.proofs(*frames(spark, facts, types), WHY, most=2).collect()
    for g, all_ in want.items():
        assert {(r.s, r.p, r.o) for r in rows if r.g == g} == all_  # every entailed fact has a proof, and nothing else has
    said = {(g, " ".join(x)) for g, *x in facts} | {(g, f"{i} rdf:type {c}") for g, i, c in types}
    for r in rows:
        assert all(x in AXIOMS or (r.g, x) in said for x in r.proof) and r["size"] == len(r.proof)
        assert entails(r.proof, (r.s, r.p, r.o))
        assert not any(entails(set(r.proof) - {x}, (r.s, r.p, r.o)) for x in r.proof)  # a justification: nothing in it can go


def test_proofs_as_paths(spark):
    f, y = frames(spark, [("g", "a", "p", "b"), ("g", "b", "r", "c"), ("g", "c", "p", "d")], [])
    got = {(r.s, r.p, r.o): (r.tag, r.description) for r in paths.tagged(provenance.as_paths(provenance.proofs(f, y, WHY, most=1))).collect()}
    assert got["a", "long", "d"][1] == "a p b and b r c and c p d and p ∘ r ∘ p → long"
    assert got["a", "rdf:type", "C"] == ("DDHHRM", "a p b and A SubClassOf C and domain(p) = A")


def test_proofs_leave_shared_rows_to_one_table(spark, monkeypatch):
    """What follows from one fact alone is not written out: the rows that are grow with the facts, not with the rules."""
    written = []

    def counted(df, what, save=provenance.saved):
        out = save(df, what)
        written.append(out.count())
        return out

    monkeypatch.setattr(provenance, "saved", counted)
    f, y = frames(spark, [("g", f"a{k}", "p", f"b{k % 7}") for k in range(200)], [])
    t = T(sub_property=[("p", f"q{k}") for k in range(20)], inverse=[("p", "back")], range=[("p", "A")], sub_class=[("A", "B"), ("B", "C")], symmetric=["q0"])
    rows = provenance.proofs(f, y, t, most=2).collect()
    assert sum(written) < 1000  # 200 facts, 7 ends, and both ways of q0
    assert len({(r.s, r.p, r.o) for r in rows}) == 200 * 23 + 21 and {(r.p, r["size"]) for r in rows} >= {("p", 1), ("q3", 2), ("back", 2), ("q0", 3)}
    assert sum(r.p == "rdf:type" for r in rows) == 42 and sum(r.p == "p" for r in rows) == 200


def test_proofs_of_what_is_said_and_follows(spark):
    """A statement that no rule starts from has its own proof and those of the rules that end in it, in one row."""
    f, y = frames(spark, [("g", "a", "p", "b"), ("g", "a", "q", "b"), ("g", "c", "p", "d")], [("g", "a", "A")])
    t = T(sub_property=[("p", "q")], domain=[("p", "A")])
    found = {(r.s, r.p, r.o): r.proofs for r in provenance.by_fact(f, y, t, most=2).where("p IN ('q', 'rdf:type')").collect()}
    by_rule = "p rdfs:subPropertyOf q"
    assert found == {
        ("a", "q", "b"): [["a q b"], ["a p b", by_rule]], ("c", "q", "d"): [["c p d", by_rule]],
        ("a", "rdf:type", "A"): [["a rdf:type A"], ["a p b", "domain(p) = A"]], ("c", "rdf:type", "A"): [["c p d", "domain(p) = A"]],
    }
    assert provenance.by_fact(f, y, t, most=2).count() == 6


def test_justifications_of_all_facts_and_types(spark, tmp_path):
    """Every table is read: parts, suppliers and types too, with nulls, repeated keys and more proofs than are kept."""
    duckdb = pytest.importorskip("duckdb")
    tables = {
        "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 1)]),
        "customer": ("c_custkey int, c_nationkey int, c_mktsegment string", [(1, 0, "BUILDING"), (2, 1, ""), (3, None, None), (4, 0, "BUILDING"), (4, 1, "MACHINERY")]),
        "supplier": ("s_suppkey int, s_nationkey int", [(1, 0), (2, None)]),
        "part": ("p_partkey int, p_type string", [(1, "SMALL TIN"), (2, None), (3, ""), (4, "SMALL TIN"), (4, "LARGE"), (4, "PROMO")]),
        "orders": ("o_orderkey int, o_custkey int", [(1, 1), (2, 1), (3, 1), (4, 4), (5, None), (6, 9)]),
        "lineitem": ("l_orderkey int, l_partkey int, l_suppkey int", [(1, 1, 1), (1, 1, 1), (1, 3, 2), (1, 4, 7), (2, 2, 1), (7, 4, 1), (7, 3, 2), (7, 1, 3), (8, None, None)]),
    }
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ["s", "p", "o", "rank", "size", "proof"]
    got = sorted(tuple(r) for r in reason_queries.e_justifications(spark, str(tmp_path)).select(columns).collect())
    of = lambda *fact: [r[5] for r in got if r[:3] == fact]
    assert of("order_1", "hasPart", "part_1") == ["order_1 hasPart part_1"] and of("order_7", "suppliedBy", "supplier_3")
    assert of("order_7", "rdf:type", "Order") == [f"domain(suppliedBy) = Order; order_7 suppliedBy supplier_{k}" for k in (1, 2)]
    assert of("order_1", "rdf:type", "Order") == ["order_1 rdf:type Order", "domain(placedBy) = Order; order_1 placedBy customer_1"]
    assert of("order_1", "rdf:type", "GoodsOrder") == ["hasPart someValuesFrom Part; order_1 hasPart part_3; part_3 rdf:type Part", "LargePart SubClassOf Part; hasPart someValuesFrom Part; order_1 hasPart part_4; part_4 rdf:type LargePart"]
    assert of("customer_1", "rdf:type", "Party")[0] == "BuildingCustomer SubClassOf Customer; Customer SubClassOf Party; customer_1 rdf:type BuildingCustomer"
    assert of("supplier_2", "rdf:type", "Party") == ["Supplier SubClassOf Party; supplier_2 rdf:type Supplier"]
    assert got == sorted(con.execute(f"select {', '.join(columns)} from ({reason_queries.ORACLES['e_justifications']})").fetchall())


def test_chain_backwards_makes_few_pairs(spark, monkeypatch):
    """One supplier of 300 orders by 300 customers: no table of supplier and customer pairs, none of what nothing needs."""
    written = []

    def counted(df, what, save=reasoner.saved):
        out = save(df, what)
        written.extend(r.k for r in out.select("k").collect())
        return out

    monkeypatch.setattr(reasoner, "saved", counted)
    rows = [("g", f"o{k}", "by", "s1") for k in range(300)] + [("g", f"o{k}", "of", f"c{k}") for k in range(300)] + [("g", f"c{k}", "in", f"n{k % 3}") for k in range(300)]
    f, y = frames(spark, [*rows, *(("g", f"n{k}", "at", "r") for k in range(3))], [])
    t = T(inverse=[("sold", "by")], chains=[("sold", "of", "in", "at", "serves"), ("in", "at", "where")], sub_property=[("serves", "knows")])
    got = reasoner.closure(f, y, rules.compiled(t, backwards=True), wanted={"serves", "knows"}).facts
    assert sorted((r.s, r.p, r.o) for r in got.where("p IN ('serves', 'knows')").collect()) == [("s1", "knows", "r"), ("s1", "serves", "r")]
    assert "by" not in written and not any(k.startswith("state sold") for k in written)
    both = [{tuple(r) for r in reasoner.closure(f, y, rules.compiled(t, backwards=b)).facts.collect()} for b in (False, True)]
    assert both[0] == both[1] and ("g", "c1", "where", "r") in both[0]
