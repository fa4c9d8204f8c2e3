"""Nulls, empty tables, repeated rows and bounds of the finders, descriptions, samples and scores."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import abstraction, answers, closure, describe, finders, models, paths, sampling, verbal
from graphloom.operators.closure import Terminology

FACT, TYPE = "s string, p string, o string", "i string, c string"


def test_finders_on_odd_rows(spark):
    t = Terminology(sub_property=[("q", "p"), ("r", "q"), ("p", "r")], inverse=[("p", "back")], chains=[("a", "b", "p")], domain=[("p", "C")], sub_class=[("A", "B"), ("B", "A")], some=[("p", "D", "E")])
    rows = [("x", "r", "y"), ("x", "r", "y"), ("x", "p", None), (None, "p", "y"), ("u", "back", "v"), ("m", "a", "n"), ("n", "b", "o"), ("n", "b", "k")]
    facts = spark.createDataFrame(rows, FACT)
    got = {r.i: (r.kind, r.evidence) for r in finders.traces(facts, t, ["p"]).collect()}
    assert got == {"x": ("sub-property", ["x r y"]), "v": ("inverse", ["u back v"]), "m": ("chain", ["m a n", "n b k"])}
    none, types = facts.where("false"), spark.createDataFrame([("x", "A"), ("x", "A"), (None, "A")], TYPE)
    assert finders.traces(none, t, ["p"]).count() == finders.domain_trace(none, t).count() == 0
    assert [(r.s, r.o, r.complexity) for r in finders.class_trace(types, t).collect()] == [("x", "B", 2)]
    assert finders.existential_asserted(none, none, types, types, t).count() == finders.intersection_asserted(types, types, [("Z", ["A"])]).count() == 0
    assert [r.s for r in finders.universal_vacuous(types.select("i"), facts, [("U", "zz", "D")]).collect()] == ["x"]
    assert paths.direct(facts).where("axioms[0].text is null").count() == 2


def test_fixpoints_and_lists_refuse_what_they_cannot_finish(spark):
    chain = spark.createDataFrame([(f"n{k}", "p", f"n{k + 1}") for k in range(12)], FACT).withColumn("g", F.lit("g"))
    t = Terminology(transitive=["p"])
    assert closure.close_facts(chain, t).count() == 78
    with pytest.raises(RuntimeError):
        closure.close_facts(chain, t, max_rounds=1)
    questions = spark.createDataFrame([("t",)], "task_id string")
    done = spark.createDataFrame([], "task_id string, model string")
    with pytest.raises(ValueError):
        models.unanswered(questions, spark.range(1001).select(F.col("id").cast("string").alias("model")), done)


def test_descriptions_on_odd_rows(spark):
    t = spark.createDataFrame([("A", "rdf:type", "owl:Class"), ("A", "rdf:type", "owl:Class"), ("B", "rdf:type", "owl:Class"), ("A", "owl:disjointWith", "B"), ("A", "rdfs:subClassOf", None), ("i", "rdf:type", "A"), ("B", "rdfs:label", "Zed"), ("B", "skos:prefLabel", "Ann")], FACT)
    assert {r.node: r.text for r in describe.class_text(t).collect()} == {"A": "A is disjoint with Zed.", "B": "Zed is a class in this ontology."}
    assert [r.node for r in describe.individuals(t).collect()] == ["i"]
    empty = t.where("false")
    assert describe.class_text(empty).count() == describe.property_text(empty).count() == describe.individuals(empty).count() == 0
    one = spark.range(1).select(verbal.listed(F.array().cast("array<string>")), verbal.listed(F.array(F.lit("a"))), verbal.listed(F.array(*map(F.lit, "abc"))))
    assert one.first()[:] == ("", "a", "a, b, and c")


def test_abstraction_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "ns1:Cat ns1:Cat <http://e/o#Cat> x")], "k int, text string")
    assert {r.k: r.mode for r in abstraction.modes(rows, "k", "text").collect()} == {1: "unknown", 2: "unknown", 3: "uri"}
    mapping = spark.createDataFrame([("Cat", "Class1")], "term string, abstract string")
    new = "<http://www.example.com/abstracted.owl#Class1>"
    assert {r.k: r.text for r in abstraction.rewrite_names(rows, mapping, "k", "text", "ns1").collect()} == {1: "", 2: "", 3: f"{new} {new} {new} x"}
    assert abstraction.terms(rows, "k", "text", "ns1").collect() == [("Cat", "object property")]


def test_samples_and_scores_on_odd_rows(spark):
    empty = spark.createDataFrame([], "stratum string, n long")
    assert sampling.quotas(empty, 5).count() == 0 and spark.range(1).select(sampling.bucket(F.lit(1.0), [])).first()[0] is None
    sizes = spark.createDataFrame([("a", 1), ("b", 10), ("c", 89)], "stratum string, n long")
    for total, want in ((10, 10), (1, 3), (1000, 100)):
        q = {r.stratum: (r.n, r.quota) for r in sampling.quotas(sizes, total).collect()}
        assert sum(x for _, x in q.values()) == want and all(1 <= x <= n for n, x in q.values())
    s = spark.createDataFrame([("m", None, 1.0), ("m", "BIN", 0.0)], "model string, answer_type string, score double")
    assert sorted((str(r.answer_type), r.n) for r in answers.summary(s).collect()) == [("ALL", 2), ("BIN", 1), ("None", 1)]
    rows = spark.createDataFrame([("a", k % 5 / 4) for k in range(100)] + [("b", 1.0) for _ in range(100)] + [("c", 0.5)], "model string, score double")
    got = {r.model: r for r in answers.bootstrap(rows).collect()}
    assert abs(got["a"].mean - 0.5) < 0.02 and 0.38 < got["a"].low < 0.46 and 0.54 < got["a"].high < 0.62 and got["b"].low == 1.0 and got["c"].low is None
    tests = {(r.a, r.b): (r.significance, r.p_value) for r in answers.rank_test(rows).collect()}
    assert tests["a", "b"][0] == "***" and tests["a", "c"] == (None, None)
    marks = answers.quality(F.lit(None).cast("string"), F.lit("x"), F.lit("x"), F.lit("BIN"))
    assert spark.range(1).select(*marks.values()).first()[:] == (0.0, 0.0, 0.0, 0.0)


def test_rewriting_keeps_rows_apart(spark):
    rows = spark.createDataFrame([(1, "ns.1:Cat eats"), (1, "big ns.1:Cat"), (1, "big ns.1:Cat"), (2, None), (3, ""), (None, "nsx1:Cat"), (4, "Cat cat")], "k int, text string")
    mapping = spark.createDataFrame([("Cat", "Class2"), ("Cat", "Class1"), ("big", "Individual1")], "term string, abstract string")
    new = "<http://www.example.com/abstracted.owl#Class1>"
    got = abstraction.rewrite_names(rows, mapping, "k", "text", "ns.1").collect()
    assert sorted((r.k or 0, r.text) for r in got) == sorted([(1, f"{new} eats"), (1, f"big {new}"), (1, f"big {new}"), (2, ""), (3, ""), (0, "nsx1:Cat"), (4, "Cat cat")])
    got = verbal.rewrite(rows, mapping, "k", "text").collect()
    want = [(1, "ns.1:Class1 eats"), (1, "Individual1 ns.1:Class1"), (1, "Individual1 ns.1:Class1"), (2, None), (3, ""), (0, "nsx1:Class1"), (4, "Class1 cat")]
    assert sorted(((r.k or 0, r.text) for r in got), key=str) == sorted(want, key=str)


def test_bootstrap_is_as_wide_as_plain_resampling(spark):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(3)
    plain, rows = [], []
    for m in range(24):
        x = np.round(rng.beta(2, 1, 400), 7) if m % 2 else rng.integers(0, 5, 400) / 4
        rows += [(f"m{m}", float(v)) for v in x]
        means = x[rng.integers(0, 400, (4000, 400))].mean(1)
        plain.append((m, np.quantile(means, 0.975) - np.quantile(means, 0.025)))
    got = {r.model: r.high - r.low for r in answers.bootstrap(spark.createDataFrame(rows, "model string, score double")).collect()}
    for kind in (0, 1):  # values seen often, values seen once
        ratio = [got[f"m{m}"] / w for m, w in plain if m % 2 == kind]
        assert abs(sum(ratio) / len(ratio) - 1) < 0.03


def test_split_by_total_and_hot_stratum(spark):
    df = spark.createDataFrame([(k, "hot" if k % 10 else None if k % 20 else "cold") for k in range(1000)], "k int, s string")
    chosen = sampling.split(df, "s", "k", total=50)
    assert chosen.count() == 1000
    n = {r.s: r["count"] for r in chosen.where("chosen").groupBy("s").count().collect()}
    assert sum(n.values()) == 50 and set(n) == {"hot", "cold", None} and n["hot"] > 40
    for out in (sampling.split(df, "s", "k"), verbal.numbered(df.selectExpr("s AS category", "string(k) AS term"))):
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
