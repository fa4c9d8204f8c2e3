"""Files between stages, model calls with a stand-in client, streams."""

from pyspark.sql import functions as F

from graphloom.operators import answers, models
from graphloom.sources import files
from graphloom.streaming import first_wins


def test_cut_off_json(spark, tmp_path):
    whole = '{"a|p|b": {"explanationCount": 1, "explanations": [["x", "y", "TAG:DHH"], ["x", "TAG:D"]], "sparqlQueries": ["ASK 1"]}, "c|p|d": {"explanationCount": 2'
    assert [k for k, _ in files.leading_entries(whole)] == ["a|p|b"]
    assert files.leading_entries("") == [] and files.leading_entries("{}") == []
    (tmp_path / "e.json").write_text(whole)
    e = files.read_explanations(spark, str(tmp_path))
    assert e.first().explanationCount == 1
    assert answers.shortest_tags(e).collect() == [("ASK 1", "a|p|b", "HH")]


def test_questions_round_trip(spark, tmp_path):
    row = ("1hop-x", "x", 1, 2, "Membership", "BIN", 'ASK "q"\nx', "p", "TRUE", 1, 2)
    df = spark.createDataFrame([row], ", ".join(f"`{c}` {'int' if isinstance(v, int) else 'string'}" for c, v in zip(files.QUESTION_COLUMNS, row, strict=True)))
    files.write_questions(df, str(tmp_path / "q"))
    back = files.read_questions(spark, str(tmp_path / "q")).first()
    assert back["SPARQL Query"] == 'ASK "q" x' and back["Size of ontology ABox"] == 2


def test_models(spark):
    def client():
        def call(model, text):
            if "bad" in text:
                raise ValueError("invalid key")
            return f"{model}: {text}"

        return call

    pairs = spark.createDataFrame([("t1", "m", "good"), ("t2", "m", "bad")], "task_id string, model string, prompt string")
    got = {r.task_id: r.response for r in models.ask(pairs, client, wait=0, partitions=1).collect()}
    assert got == {"t1": "m: good", "t2": "[ERROR] invalid key"}


def test_fuzzy(spark):
    q = spark.createDataFrame([("a b c d e f g h i j k",), ("zz yy",)], "query string")
    i = spark.createDataFrame([("a b c d e f g h i j",), ("a b c",), ("q r",)], "query string")
    assert answers.fuzzy_queries(q, i).collect() == [("a b c d e f g h i j k", "a b c d e f g h i j")]


def test_stream_first_wins(spark, tmp_path):
    facts = spark.createDataFrame([("r1", "a", "p", "b"), ("r2", "a", "p", "b"), ("r2", "c", "p", "d")], "root string, s string, p string, o string")
    facts.write.parquet(str(tmp_path / "in"))
    seen = []
    q = first_wins.write_questions(spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in")), lambda df, epoch: seen.extend(r.key for r in df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["a|p|b", "c|p|d"]


def test_mapping(spark, tmp_path):
    (tmp_path / "m.txt").write_text("=== CLASSES ===\n\nAda -> <http://x#Class1>\n")
    assert files.read_mapping(spark, str(tmp_path)).collect() == [("Ada", "Class1")]
    t = spark.createDataFrame([("g", "http://s", "http://p", 'a "b"', "literal", None, "en")], "graph_id string, s string, p string, o string, o_kind string, o_dtype string, o_lang string")
    assert files.turtle_lines(t).first().value == '<http://s> <http://p> "a \\"b\\""@en .'
    assert F


def test_sinks(spark, tmp_path):
    numbered = spark.createDataFrame([("class", "B", "Class2"), ("class", "A", "Class1"), ("individual", "x", "Individual1")], "category string, term string, abstract string")
    assert [r.value for r in files.mapping_lines(numbered).collect()] == ["=== CLASSES ===", "A -> <http://www.example.com/abstracted.owl#Class1>", "B -> <http://www.example.com/abstracted.owl#Class2>", "=== OBJECT PROPERTIES ===", "=== DATA PROPERTIES ===", "=== INDIVIDUALS ===", "x -> <http://www.example.com/abstracted.owl#Individual1>"]
    files.write_mapping(numbered, str(tmp_path / "m"))
    assert sorted(files.read_mapping(spark, str(tmp_path / "m")).collect()) == [("A", "Class1"), ("B", "Class2"), ("x", "Individual1")]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.TTL").write_text("x\ny")
    (tmp_path / "deep" / "b.txt").write_text("no")
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "deep")).collect()] == ["x\ny"]
    names = spark.createDataFrame([("g", "G", "general", 3, "d"), ("h", "H", None, 0, None)], "graph_id string, name string, structuralType string, triples long, description string")
    entries = spark.createDataFrame([("g", "class", "B", "b"), ("g", "class", "A", "a"), ("g", "individual", "I", "i")], "graph_id string, part string, label string, text string")
    files.write_json(files.verbalised(names, entries).drop("graph_id"), str(tmp_path / "v"))
    back = {r.ontology.name: r for r in files.read_verbalised(spark, str(tmp_path / "v")).collect()}
    assert [c.classLabel for c in back["G"].classes] == ["A", "B"] and back["H"].classes == [] and back["G"].individuals[0].description == "i"
    for run, answer in (("r1", "old"), ("r2", "new"), ("r2", "new")):
        files.write_checkpoint(spark.createDataFrame([("t", "m", answer)], "task_id string, model string, response string"), str(tmp_path / "c"), run)
    assert [r.response for r in files.read_checkpoints(spark, str(tmp_path / "c")).collect()] == ["new"]
    found = files.findings(spark.createDataFrame([("m", "ALL", 4, 1, 2, 1, 0.5, 0.25), ("m", None, 0, 0, 0, 0, None, None)], "model string, answer_type string, n long, perfect long, partial long, wrong long, mean double, std double"))
    assert found.first()[2:] == ("4", "25.0%", "50.0%", "25.0%", "50.0%", "25.0%") and found.count() == 2
    facts = spark.createDataFrame([("g", "http://a/s", "http://a/p", "v", "literal", None, None)], "graph_id string, s string, p string, o string, o_kind string, o_dtype string, o_lang string")
    files.write_modules(facts, str(tmp_path / "mod"))
    assert sorted(r.value[:30] for r in spark.read.text(str(tmp_path / "mod")).collect())[0].startswith("<http://a/s>")
    name = files.module_name(F.array(F.lit("C"), F.lit("A"), F.lit("B")), F.lit("x"))
    assert spark.range(1).select(name, files.module_name(F.array().cast("array<string>"), F.lit("x"))).first()[:] == ("A_B_x", "Thing_x")
