"""Rounds of answers over a stream: a question stays open until all its models have answered or its time is over.

Each question is a key with state of its own (Spark's transformWithState): the earliest answer of each model, at most one a
model, and a timer in event time. Closed questions are emitted once, in the batch in which the last model answers or the
watermark passes the deadline. State lives in Spark's state store, so a lost executor or a restart from the checkpoint goes
on where the stream stood.

Defined cases: of a model's repeated answers the earliest counts, of equal times the least text; answers later than the
first one's time plus `wait` don't count; neither do null and empty responses, null times and models not asked for; null
task ids are no question. Answers to a closed question change nothing until `keep` after its deadline, when its state is
let go; one that comes later still opens a new round. Rows behind the watermark are dropped by Spark. An empty stream
closes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Closed questions: what closed them ('complete' or 'timeout'), and each counted answer with its milliseconds after the first.
CLOSED = "task_id string, opened_ms long, closed_by string, answered int, complete boolean, missing array<string>, answers array<struct<model: string, response: string, seconds: double, after_ms: long>>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rounds(StatefulProcessor):
    """State of one question, read and written as one value: its deadline, whether it is closed, and while it is open the
    earliest answer of each model. The one timer stands at the deadline, and once closed `keep` after it."""

    def __init__(self, models: list[str], wait_ms: int, keep_ms: int):
        self.models, self.wait, self.keep = sorted(set(models)), wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("round", "deadline long, closed boolean, models array<string>, times array<long>, responses array<string>, seconds array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        if held and held[1]:
            return
        best = {m: (at, r, s) for m, at, r, s in zip(*held[2:], strict=True)} if held else {}
        for r in rows:  # one answer a model is held, however many rows the key has
            new = (r.at_ms, r.response, r.seconds)
            if r.model not in best or new[:2] < best[r.model][:2]:
                best[r.model] = new
        if not best:
            return
        deadline = min(v[0] for v in best.values()) + self.wait
        best = {m: v for m, v in best.items() if v[0] <= deadline}
        if held and (len(best) == len(self.models) or held[0] != deadline):
            self.handle.deleteTimer(held[0])
        if len(best) == len(self.models):
            yield self._close(key, best, "complete", deadline)
            return
        if not held or held[0] != deadline:
            self.handle.registerTimer(deadline)
        self.state.update((deadline, False, list(best), *(list(x) for x in zip(*best.values(), strict=True))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held and held[1]:
            self.state.clear()
        elif held:
            yield self._close(key, {m: (at, r, s) for m, at, r, s in zip(*held[2:], strict=True)}, "timeout", held[0])

    def _close(self, key, best: dict[str, tuple], why: str, deadline: int) -> Row:
        self.state.update((deadline, True, [], [], [], []))
        self.handle.registerTimer(deadline + self.keep)
        first = deadline - self.wait
        told = [Row(model=m, response=best[m][1], seconds=best[m][2], after_ms=best[m][0] - first) for m in self.models if m in best]
        missing = [m for m in self.models if m not in best]
        return Row(task_id=key[0], opened_ms=first, closed_by=why, answered=len(told), complete=not missing, missing=missing, answers=told)

    def close(self) -> None:
        pass


def answer_rounds(responses: DataFrame, models: list[str], *, wait_ms: int = 600_000, keep_ms: int = 3_600_000, delay: str = "1 minute") -> DataFrame:
    """Closed questions (CLOSED) of a stream (task_id, model, response, seconds, at timestamp).

    wait_ms: how long after its first answer a question stays open; keep_ms: how long after that it is remembered as
    closed; delay: how late a row may come. The state store must be RocksDB's, as `write_rounds` sets it.
    """
    if not models:
        raise ValueError("no models to wait for")
    rows = responses.withWatermark("at", delay).where(F.col("task_id").isNotNull() & F.col("at").isNotNull() & (F.col("response") != "") & F.col("model").isin(*set(models)))
    rows = rows.select("task_id", "model", "response", F.col("seconds").cast("double").alias("seconds"), "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("task_id").transformWithState(Rounds(models, wait_ms, keep_ms), CLOSED, "Append", "EventTime")


def model_statistics(closed: DataFrame, models: list[str]) -> DataFrame:
    """(model, asked, answered, errors, success_rate, mean_seconds) over closed questions, a row for each of `models`;
    errors are answers that start with '[ERROR]', success_rate their complement among the asked (null if none)."""
    told = closed.select(F.explode("answers").alias("a")).select("a.*")
    error = F.col("response").startswith("[ERROR]")
    by_model = told.groupBy("model").agg(F.count(F.lit(1)).alias("answered"), F.count(F.when(error, 1)).alias("errors"), F.avg(F.when(~error, F.col("seconds"))).alias("mean_seconds"))
    asked = closed.agg(F.count(F.lit(1)).alias("asked")).crossJoin(closed.sparkSession.createDataFrame([(m,) for m in sorted(set(models))], "model string"))  # one row beside the models
    out = asked.join(by_model, "model", "left").fillna(0, ["answered", "errors"])
    return out.select("model", "asked", "answered", "errors", F.when(F.col("asked") > 0, (F.col("answered") - F.col("errors")) / F.col("asked")).alias("success_rate"), "mean_seconds")


def wide(closed: DataFrame, models: list[str]) -> DataFrame:
    """(task_id, closed_by, <model>_response, <model>_seconds, ...): one row a closed question, null where a model is missing."""
    pick = lambda m: F.get(F.filter("answers", lambda a: a["model"] == m), F.lit(0))
    return closed.select("task_id", "closed_by", *(pick(m)[x].alias(f"{m}_{x}") for m in sorted(set(models)) for x in ("response", "seconds")))


def write_rounds(responses: DataFrame, models: list[str], out: str, checkpoint: str, *, available_now: bool = False, **settings) -> StreamingQuery:
    """Starts the stream; each batch's closed questions go to `out`/closed and its statistics by model to `out`/statistics.

    A batch that is run again after a failure overwrites its own folder, so every closed question is there once.
    """
    conf = responses.sparkSession.conf

    def sink(closed: DataFrame, batch: int) -> None:
        closed.write.mode("overwrite").parquet(f"{out}/closed/batch={batch}")
        held = closed.sparkSession.read.schema(CLOSED).parquet(f"{out}/closed/batch={batch}")
        model_statistics(held, models).write.mode("overwrite").json(f"{out}/statistics/batch={batch}")

    writer = answer_rounds(responses, models, **settings).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    setting, before = "spark.sql.streaming.stateStore.providerClass", conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set(setting, STORE)
    try:  # a stream keeps the settings it starts with
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(setting, before)


def read_rounds(spark: SparkSession, out: str) -> DataFrame:
    """All closed questions written to `out`, with the batch that closed each."""
    return spark.read.schema(CLOSED + ", batch long").parquet(f"{out}/closed")
