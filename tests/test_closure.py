"""Closure rules on a small family, and properties of the closure."""

from graphloom.operators import closure, graph, paths

T = closure.Terminology(
    sub_property=[("isSisterOf", "isSiblingOf"), ("isMotherOf", "isParentOf"), ("isFatherOf", "isParentOf"), ("isChildOf", "hasAncestor"), ("hasAncestor", "hasRelation")],
    inverse=[("isParentOf", "isChildOf")], symmetric=["isSiblingOf", "hasRelation"], transitive=["hasAncestor", "isSiblingOf"],
    chains=[("isChildOf", "isParentOf", "isSiblingOf")], domain=[("isMotherOf", "Woman")], range=[("isChildOf", "Person")], sub_class=[("Woman", "Person")],
    exists=[("Person", "isChildOf", "Person")],
    intersections=[("Matriarch", ["Woman", ("isParentOf", "Person")])],
)
FACTS = [("g", "sarah", "isMotherOf", "ada"), ("g", "sarah", "isMotherOf", "gwen"), ("g", "priscilla", "isMotherOf", "sarah"), ("h", "ada", "isSisterOf", "zoe")]


def closed(spark):
    f = spark.createDataFrame(FACTS, "g string, s string, p string, o string")
    return closure.close_facts(f, T)


def test_facts(spark):
    rows = {tuple(r) for r in closed(spark).collect()}
    assert ("g", "ada", "isSiblingOf", "gwen") in rows
    assert ("g", "ada", "hasAncestor", "priscilla") in rows
    assert ("g", "priscilla", "hasRelation", "ada") in rows
    assert ("h", "zoe", "isSiblingOf", "ada") in rows
    assert not any(r[0] == "h" and r[1] == "gwen" for r in rows)  # graphs don't mix


def test_idempotent_and_monotone(spark):
    once = closed(spark)
    again = {tuple(r) for r in closure.close_facts(once, T).collect()}
    assert again == {tuple(r) for r in once.collect()} >= set(FACTS)


def test_types(spark):
    f = closed(spark)
    none = spark.createDataFrame([], "g string, i string, c string")
    rows = {tuple(r) for r in closure.close_types(none, f, T).collect()}
    assert ("g", "sarah", "Woman") in rows and ("g", "sarah", "Person") in rows and ("g", "priscilla", "Matriarch") in rows
    assert ("g", "sarah", "Matriarch") not in rows  # nothing says that her children are persons
    assert ("g", "ada", "Person") not in rows


def test_self_rule():
    assert ("Person", "isSiblingOf") in T.self_rules()


def test_violations(spark):
    f = spark.createDataFrame([("g", "a", "p", "a"), ("g", "a", "p", "b")], "g string, s string, p string, o string")
    t = spark.createDataFrame([("g", "a", "C"), ("g", "a", "D")], "g string, i string, c string")
    rules = {r.rule for r in closure.violations(f, t, closure.Terminology(functional=["p"], irreflexive=["p"], disjoint=[("C", "D")])).collect()}
    assert rules == {"functional", "irreflexive", "disjoint"}


def test_empty(spark):
    f = spark.createDataFrame([], "g string, s string, p string, o string")
    assert closure.close_facts(f, T).count() == 0


def test_hops(spark):
    f = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d")], "s string, p string, o string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert graph.one_hop(f, roots).count() == 1
    assert graph.two_hop(f, roots).count() == 2
    assert {r.node for r in graph.reachable(f, roots, 2).collect()} == {"a", "b", "c"}
    assert graph.n_hop(f, roots, 3).count() == 3


def test_class_chains_have_no_loops():
    t = closure.Terminology(sub_class=[("A", "B"), ("B", "C"), ("C", "A")], equivalent_class=[("B", "D")])
    ways = paths.class_chains(t)
    assert ("A", "C", ["A", "B", "C"]) in ways and all(len(set(w)) == len(w) for _, _, w in ways)
