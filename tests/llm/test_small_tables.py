"""Small tables under many shuffle partitions: a job has as many tasks as the counted rows call for, with equal results."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

pytest.importorskip("pyarrow")

from graphloom.llm import bits, graph, quality, work  # noqa: E402

PARTITIONS = 60


@pytest.fixture
def many(spark):
    """Runs a function with many shuffle partitions that stay as they are; gives its result, its jobs and their tasks."""
    keep = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)

    def run(name, function):
        spark.sparkContext.setJobGroup(name, name)
        got = function()
        tracker = spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(name)
        stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
        return got, len(jobs), sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))

    yield run
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bit_table_takes_few_jobs(spark, many):
    keys = work.saved(spark.range(0, 9000, 1, 3).selectExpr("xxhash64(id) key"), "test")
    table, jobs, _ = many("bits", lambda: bits.bit_table(keys))
    assert jobs < 10  # one a partition before
    at = {k >> (64 - 18) & (1 << 18) - 1 for k in (r.h & (1 << 64) - 1 for r in keys.selectExpr("xxhash64(key) h").collect())}
    assert len(table) == 1 << 15
    assert set(np.flatnonzero(np.unpackbits(table)).tolist()) == at


def test_components_of_few_edges(spark, many, monkeypatch):
    edges = [(i, i + 1) for i in range(1, 40) if i % 10] + [(7, 7), (50, 50), (60, 61), (60, 61), (None, 3)]
    edges = work.saved(spark.createDataFrame(edges, "a long, b long"), "test")
    want = {i: (i - 1) // 10 * 10 + 1 for i in range(1, 41)} | {50: 50, 60: 60, 61: 60}
    run = lambda: {r.node: r.comp for r in graph.components(edges).collect()}
    got, _, tasks = many("few", run)
    assert got == want
    assert tasks < 4 * PARTITIONS  # a shuffle or more a step of each round before
    monkeypatch.setattr(work.alone, "__defaults__", (0,))
    assert run() == want  # as larger tables are done


def test_concentration_steps_on_few_rows(spark, many):
    rng = np.random.default_rng(3)
    rows = [(g, *map(float, r)) for g in "ab" for r in rng.normal(size=(80, quality.P))]
    used = work.saved(spark.createDataFrame(rows, "grp string, " + ", ".join(f"{f} double" for f in quality.FEATURES)), "test")
    plain = lambda: sorted(map(tuple, quality.determinants(used, h=0.5)[0].collect()))
    want = plain()
    got, _, tasks = many("steps", plain)
    assert [r[0] for r in got] == [r[0] for r in want] == ["a", "b"]
    assert np.allclose([r[1:] for r in got], [r[1:] for r in want], rtol=1e-9, atol=1e-9)
    assert tasks < 6 * PARTITIONS  # two shuffles a step before
