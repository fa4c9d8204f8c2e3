"""Positions within groups against sorting in Python, and a plan without a window over a group's rows."""

import random

from graphloom.operators import numbering


def test_positions(spark):
    random.seed(2)
    rows = [(random.choice(["a", "a", "a", "b", None]), random.choice([None, *range(40)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(7)
    got = sorted(numbering.numbered(df, ["g"], ["k", "i"], "position", "size", partitions=5).collect(), key=lambda r: r.i)
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {i: (g, k, place, len(own)) for place, (_, k, i) in enumerate(own)}
    assert {r.i: (r.g, r.k, r.position, r.size) for r in got} == want


def test_one_group_ties_and_empty(spark):
    df = spark.createDataFrame([(5,)] * 30, "k int")
    assert sorted(r.position for r in numbering.numbered(df, [], ["k"]).collect()) == list(range(30))
    assert numbering.numbered(df.where("k < 0"), [], ["k"], size="n").count() == 0


def test_no_window_over_rows(spark):
    df = numbering.numbered(spark.range(1000).selectExpr("id % 2 AS g", "id"), ["g"], ["id"])
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
