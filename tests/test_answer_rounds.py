"""Rounds of answers: late, repeated and missing answers, deadlines, recovery from the checkpoint."""

import datetime as dt

import pytest

from graphloom.streaming import answer_rounds as rounds

SCHEMA = "task_id string, model string, response string, seconds double, at timestamp"
START = dt.datetime(2026, 1, 1)


@pytest.fixture
def play(spark, tmp_path):
    """Adds one file of (task, model, response, minute) and lets the stream take all there is; each call is a restart."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run(*rows, delay="0 seconds"):
        at = [(t, m, r, 1.0, None if k is None else START + dt.timedelta(minutes=k)) for t, m, r, k in rows]
        spark.createDataFrame(at, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = rounds.write_rounds(stream, ["a", "b"], out, checkpoint, available_now=True, wait_ms=600_000, keep_ms=3_600_000, delay=delay)
        query.awaitTermination()
        return {r.task_id: (r.closed_by, [(x.model, x.response) for x in r.answers], r.missing) for r in rounds.read_rounds(spark, out).collect()}

    run.out = out
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield run
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rounds(spark, play):
    got = play(("q1", "a", "x", 0), ("q1", "a", "later", 1), ("q1", "b", "y", 2), ("q2", "a", "z", 1), ("q3", "b", "", 1), ("q3", "c", "no", 1), (None, "a", "n", 1), ("q3", "a", "n", None))
    assert got == {"q1": ("complete", [("a", "x"), ("b", "y")], [])}
    # after a restart: q2 is completed from stored state, q1's repeats change nothing, q4 has one answer after its deadline
    got = play(("q2", "b", "w", 5), ("q1", "b", "again", 6), ("q4", "a", "[ERROR] e", 5), ("q4", "b", "late", 16))
    assert got["q2"] == ("complete", [("a", "z"), ("b", "w")], []) and got["q1"][1] == [("a", "x"), ("b", "y")]
    assert got["q4"] == ("timeout", [("a", "[ERROR] e")], ["b"])
    # behind the watermark: dropped; q1 is still known as closed
    got = play(("q5", "a", "old", 3), ("q1", "a", "x2", 20), ("q1", "b", "y2", 20), ("q6", "b", "t", 20), ("q6", "b", "s", 20))
    assert set(got) == {"q1", "q2", "q4"} and got["q1"][1] == [("a", "x"), ("b", "y")]
    got = play(("q7", "a", "far", 200))
    assert got["q6"] == ("timeout", [("b", "s")], ["a"]) and "q5" not in got and "q7" not in got
    # q1 was let go: a new round
    play(("q1", "a", "n1", 201), ("q1", "b", "n2", 202))
    closed = rounds.read_rounds(spark, play.out)
    assert sorted(r.answered for r in closed.where("task_id = 'q1'").collect()) == [2, 2] and closed.groupBy("task_id", "batch").count().where("count > 1").count() == 0
    stats = {r.model: r[1:] for r in rounds.model_statistics(closed, ["a", "b", "z"]).collect()}
    assert stats == {"a": (5, 4, 1, 0.6, 1.0), "b": (5, 4, 0, 0.8, 1.0), "z": (5, 0, 0, 0.0, None)}
    row = rounds.wide(closed, ["a", "b"]).where("task_id = 'q4'").first()
    assert row.a_response == "[ERROR] e" and row.b_response is None and row.closed_by == "timeout"


def test_an_earlier_answer_moves_the_deadline(play):
    assert play(("q", "a", "x", 12), delay="30 minutes") == {}
    # b's answer opens the question at 1, so a's at 12 is late and the time is over at 11
    assert play(("q", "b", "y", 1), ("q", "b", "v", 5), delay="30 minutes") == {}
    assert play(("r", "a", "far", 300), delay="30 minutes") == {"q": ("timeout", [("b", "y")], ["a"])}


def test_many_repeats_of_one_question(spark, play):
    rows = [("hot", "a", f"r{k:04d}", k % 7) for k in range(3000)] + [(f"q{k}", m, "v", 3) for k in range(20) for m in "ab"]
    got = play(*rows)
    assert len(got) == 20 and play(("hot", "b", "w", 8))["hot"] == ("complete", [("a", "r0000"), ("b", "w")], [])


def test_no_models(spark):
    with pytest.raises(ValueError):
        rounds.answer_rounds(spark.createDataFrame([], SCHEMA), [])
