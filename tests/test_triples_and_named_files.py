"""Pattern scans that prune, patterns against brute force, and files that are there whole or not at all."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources import files, named_files, rdf, triples

SCHEMA = "g string, s string, p string, o string"


def rows(n=300, seed=4):
    random.seed(seed)
    return sorted({(random.choice("gh"), f"n{random.randrange(12)}", random.choice(["p", "p", "q", "r"]), f"n{random.randrange(12)}") for _ in range(n)})


def brute(facts, patterns):
    found = set()
    for g in {f[0] for f in facts}:
        own = [f[1:] for f in facts if f[0] == g]
        for pick in itertools.product(*([f for f in own if all(x.startswith("?") or x == y for x, y in zip(t, f, strict=True))] for t in patterns)):
            seen = {}
            if all(seen.setdefault(x, y) == y for t, f in zip(patterns, pick, strict=True) for x, y in zip(t, f, strict=True) if x.startswith("?")):
                found.add((g, *(seen[k] for k in sorted(seen))))
    return found


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('store')}/t"
    triples.store(spark.createDataFrame([*rows(), ("g", None, "p", "x")], SCHEMA), path, 8)
    return path


def test_patterns(spark, kept):
    scan = lambda **c: triples.scan(spark, kept, buckets=8, **c)
    for patterns in (
        [("?x", "p", "?y"), ("?y", "q", "?z")], [("?x", "p", "?x")], [("?x", "r", "n3"), ("?x", "?how", "?y")], [("n1", "p", "?y"), ("?y", "p", "?z"), ("?z", "q", "n2")],
        [("?a", "p", "?b"), ("?b", "p", "?c"), ("?c", "p", "?a")],
    ):
        names = sorted({x[1:] for t in patterns for x in t if x.startswith("?")})
        want = brute(rows(), patterns)
        for how in (scan, triples.source(spark.createDataFrame(rows(), SCHEMA))):
            assert {tuple(r) for r in triples.match(how, patterns).select("g", *names).collect()} == want
    with pytest.raises(ValueError, match="shares no variable"):
        triples.match(scan, [("?x", "p", "?y"), ("?a", "q", "?b")])


def test_constants_prune(spark, kept):
    plan = triples.scan(spark, kept, p="q", s="n1", buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(p,q)" in plan and "EqualTo(s,n1)" in plan
    assert len(triples.scan(spark, kept, p="q", buckets=8).select(F.input_file_name()).distinct().collect()) < 8


def test_named_files_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("a b", "http://x#s", "http://x#p", 'say "hi"\nyou', "literal", None, "en"), ("a b", "http://x#s", "http://x#q", "http://x#o", "iri", None, None), ("c", "http://x#s", "http://x#p", "http://x#o", "iri", None, None)], rdf.SCHEMA)
    named_files.write_graphs(t, str(tmp_path / "m"))
    assert sorted(os.listdir(tmp_path / "m")) == ["a_b.ttl", "c.ttl"]
    back = rdf.read(spark, str(tmp_path / "m")).where("graph_id = 'a_b' AND NOT s LIKE 'http://example.org%'")
    assert {tuple(r)[1:4] for r in back.collect()} == {tuple(r)[1:4] for r in t.where("graph_id = 'a b'").collect()}
    about = {r.p.split("#")[1]: r.o for r in rdf.read(spark, str(tmp_path / "m")).where("graph_id = 'c' AND s LIKE 'http://example.org%'").collect()}
    assert about["label"] == "Module of c" and about["comment"] == "1 statements" and about["versionInfo"] == "1.0"
    named_files.write_graphs(t.where("graph_id = 'c'"), str(tmp_path / "m"))
    assert os.listdir(tmp_path / "m") == ["c.ttl"]


def test_one_json_object(spark, tmp_path):
    docs = spark.createDataFrame([(f'k"{k}|p|o', json.dumps({"n": k})) for k in range(40)] + [(None, "{}")], "key string, document string").repartition(5)
    named_files.write_explanations(docs, str(tmp_path))
    text = (tmp_path / "Explanations.json").read_text()
    assert json.loads(text) == {f'k"{k}|p|o': {"n": k} for k in range(40)}
    assert {r.key for r in files.read_explanations(spark, str(tmp_path / "Explanations.json")).collect()} == set(json.loads(text))


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(40, numPartitions=4).select(F.concat(F.lit("f"), (F.col("id") % 4).cast("string")).alias("name"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("text"))
    with pytest.raises(Exception, match="broken"):
        named_files.write_texts(bad, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="not a file's name"):
        named_files.write_texts(spark.createDataFrame([("../up", "x")], "name string, text string"), str(tmp_path / "out"))
    named_files.write_texts(spark.createDataFrame([("a.ttl", "one\n"), ("b.ttl", ""), (None, "x")], "name string, text string"), str(tmp_path / "out"))
    assert {n: (tmp_path / "out" / n).read_text() for n in os.listdir(tmp_path / "out")} == {"a.ttl": "one\n", "b.ttl": ""}
