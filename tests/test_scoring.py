"""Answer extraction and scores against hand-worked values; samples; summaries."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import answers, sampling, verbal


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("expected, actual, kind, score", [
    ("TRUE", "true", "BIN", 1.0), ("TRUE", "false", "BIN", 0.0), ("a; b", "B; a", "MC", 1.0), ("a; b", "a", "MC", 0.5), ("", "", "MC", 1.0), ("a", "", "MC", 0.0), ("Ada Heath 1868", "ada heath", "MC", 1.0), ("a,b;c", "c", "MC", 0.5),
])
def test_accuracy(spark, expected, actual, kind, score):
    assert one(spark, answers.accuracy(F.lit(expected), F.lit(actual), F.lit(kind))) == score


def test_final_answer(spark):
    assert one(spark, answers.final_answer(F.lit("x\nAnswer: Yes\n"), F.lit("BIN"))) == "TRUE"
    assert one(spark, answers.final_answer(F.lit("[ERROR] x"), F.lit("MC"))) == "ERROR"
    assert one(spark, answers.final_answer(F.lit(None).cast("string"), F.lit("MC"))) == "ERROR"


def test_hallucination(spark):
    assert one(spark, answers.hallucination(F.lit("ada; bob"), F.lit("ada; zed"), F.lit("MC"))) == 0.5
    assert one(spark, answers.hallucination(F.lit("ada"), F.lit(""), F.lit("MC"))) == 1.0
    assert one(spark, answers.hallucination(F.lit("ada"), F.lit("ada"), F.lit("BIN"))) is None


def test_rank_sum(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "model string, score double")
    u = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b)
    assert answers.rank_sum(df).first().u == u


def test_split_covers_strata(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("s"))
    got = sampling.split(df, "s", "id").where("chosen").groupBy("s").count().collect()
    assert len(got) == 7 and all(r["count"] == 7 for r in got)


def test_edges(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    e = sampling.histogram_edges(df, "v")
    assert e[0] == 0 and e[-1] == 99
    assert df.where(sampling.bucket(F.col("v"), e).isNull()).count() == 0
    assert sampling.histogram_edges(df.where("v < 0"), "v") == []


def test_sentences(spark):
    assert one(spark, verbal.sentence(F.lit("Ada"), F.lit("isSisterOf"), F.array(F.lit("Gwen"), F.lit("Lemuel")))) == "Ada is the sister of Gwen and Lemuel."
    assert one(spark, verbal.clean_name(F.lit("ada_rachel_heath_1868"))) == "Ada Rachel Heath"
    assert one(spark, verbal.property_name(F.lit("hasFemalePartner"))) == "has female partner"
