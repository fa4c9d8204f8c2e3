import pytest
import random

from pyspark.sql import functions as F

from graphloom.operators import answers, verbal


def test_strict_type_raises(spark):
    for bad in ("maybe", None, ""):
        df = spark.createDataFrame([(bad,)], "t string").select(answers.strict_answer_type(F.col("t")).alias("k"))
        with pytest.raises(Exception, match="unknown answer type"):
            df.collect()


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert answers.require_columns(df, "a") is df
    with pytest.raises(ValueError, match="missing columns"):
        answers.require_columns(df, "a", "b")


def test_completed(spark):
    rows = [(1, "m", "x"), (1, "m", "y"), (1, "n", "z"), (2, "m", ""), (2, "n", None), (3, "other", "x"), (None, "m", "x")]
    found = answers.completed(spark.createDataFrame(rows, "q int, model string, response string"), "q", ["m", "n"])
    assert {tuple(r) for r in found.collect()} == {(1, 2, True), (2, 0, False), (3, 0, False), (None, 1, False)}


def test_percent(spark):
    df = spark.createDataFrame([(0.8125,), (-0.5,), (None,), (1.0,)], "v double")
    got = [tuple(r) for r in df.select(answers.percent(F.col("v")), answers.percent(F.col("v"), signed=True)).collect()]
    assert got == [("81.2%", "+81.2%"), ("-50.0%", "-50.0%"), (None, None), ("100.0%", "+100.0%")]


def test_percentage_rounds_the_double(spark):
    random.seed(4)
    values = [48.45, 48.35, 12.25, 12.75, 99.95, 99.96, 0.05, 0.15, -0.04, -0.0, 0.0, -99.99, 1e12 + 0.25, 5e-324, 9.949999999999999]
    values += [random.uniform(-100, 100) for _ in range(2000)] + [100.0 * k / 800 for k in range(800)] + [k / 20 for k in range(-1000, 1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select("v", answers.percentage(F.col("v")), answers.percentage(F.col("v"), signed=True)).collect()]
    assert got == [(v, f"{v:.1f}%", f"{v:+.1f}%") for v in values]


def test_shares_as_the_sql_divides(spark, tmp_path):
    """99,999 orders a status whose even and odd keys differ by one, and a share that is 1/7 of all."""
    duckdb = pytest.importorskip("duckdb")
    rows = spark.range(1, 100_000).select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"))
    rows.union(spark.range(0, 16_667).select("id", F.lit("O"))).union(spark.range(0, 1999).select(F.col("id") * 2, F.lit("P"))).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    import __spark_entry__ as entry

    got = {tuple(r) for r in entry.queries()["x_percent"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(entry.oracle_sql()["x_percent"]).fetchall()) and "-0.0%" in {r[2] for r in got}


def test_replace_phrases(spark):
    names = {"Ann Lee": "I1", "Ann": "I2", "a.b": "C1", "Zoë": "I3"}
    texts = ["Ann Lee met Ann, not Anna or JoAnn.", "a.b axb a.bc", "Zoë Zoëy", "", None, "no term\n here 😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(verbal.replace_phrases(F.col("t"), names)).collect()]
    assert got == ["I1 met I2, not Anna or JoAnn.", "C1 axb a.bc", "I3 Zoëy", "", "", "no term\n here 😀"]
    assert [r[0] for r in df.select(verbal.replace_phrases(F.col("t"), {})).collect()] == [t or "" for t in texts]


def test_phrases_bound(spark):
    mapping = spark.createDataFrame([("a", "2"), ("a", "1"), ("", "x"), (None, "y"), ("b", "3")], "term string, abstract string")
    assert verbal.phrases(mapping) == {"a": "1", "b": "3"}
    with pytest.raises(ValueError):
        verbal.phrases(mapping, most=1)


def test_phrases_of_any_number(spark):
    random.seed(8)
    bits = ["has", "Part", "x", "é", "1", " ", " ", "-", "_", "(", "\n", "日本"]
    names = {"".join(random.choices(bits, k=random.randint(1, 6))): f"N{k}" for k in range(120)}
    names = {t: n for t, n in names.items() if t}
    texts = ["".join(random.choices(bits, k=random.randint(0, 40))) for _ in range(250)] + [None, "", texts_longest(names)]
    df = spark.createDataFrame([(k % 50, t) for k, t in enumerate(texts)], "k int, t string")
    want = sorted((r.k, r.t) for r in df.select("k", verbal.replace_phrases(F.col("t"), names).alias("t")).collect())
    mapping = spark.createDataFrame([(t, n) for t, n in names.items()] + [(t, "zzz") for t in names] + [("", "E"), (None, "F")], "term string, abstract string")
    assert sorted((r.k, r.t) for r in verbal.rewrite_phrases(df, mapping, "k", "t").collect()) == want
    assert verbal.rewrite_phrases(df, mapping.where("false"), "k", "t").where("t = ''").count() == sum(not t for t in texts)


def texts_longest(names):
    return " ".join(sorted(names, key=len)[-3:])


def test_a_million_terms(spark):
    mapping = spark.range(1_000_000).select(F.concat(F.lit("term "), F.col("id").cast("string")).alias("term"), F.concat(F.lit("N"), "id").alias("abstract"))
    df = spark.createDataFrame([(1, "a term 999999 of term 7, term x")], "k int, t string")
    assert verbal.rewrite_phrases(df, mapping, "k", "t").first().t == "a N999999 of N7, term x"
