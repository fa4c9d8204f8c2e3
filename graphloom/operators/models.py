"""Calls to language models: prompts out, answers in. The client is given by the caller and made once a partition."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERMANENT = ("invalid", "unauthorized", "not found", "quota")


def prompt(question, context, kind, most: int = 10_000):
    """Prompt text as a Column; the context is cut to `most` characters."""
    form = F.when(kind == "MC", "List every answer, separated by '; '.").otherwise("Answer TRUE or FALSE.")
    return F.concat(F.lit("Answer from the context alone. "), form, F.lit("\nQuestion: "), question, F.lit("\nContext: "), F.substring(context, 1, most), F.lit("\nANSWER:"))


def unanswered(questions: DataFrame, models: DataFrame, done: DataFrame) -> DataFrame:
    """Question and model pairs without a recorded answer, so a stopped run goes on where it stopped. models: a list of at
    most 1,000; a longer one is refused."""
    if models.limit(1001).count() > 1000:
        raise ValueError("more than 1,000 models")
    pairs = questions.join(F.broadcast(models), F.lit(True))
    return pairs.join(done.select("task_id", "model"), ["task_id", "model"], "left_anti")


def ask(pairs: DataFrame, client: Callable[[], Callable[[str, str], str]], tries: int = 3, wait: float = 1.0, partitions: int | None = None) -> DataFrame:
    """(task_id, model, response, seconds) of pairs(task_id, model, prompt); a failed call gives '[ERROR] ...'."""
    spread = pairs.select("task_id", "model", "prompt").repartition(partitions or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(frames):
        import pandas as pd

        call = client()
        for pdf in frames:
            rows = []
            for task, model, text in zip(pdf.task_id, pdf.model, pdf.prompt, strict=True):
                began = time.time()
                for k in range(tries):
                    try:
                        answer = call(model, text)
                        break
                    except Exception as e:  # noqa: BLE001  whatever a client raises becomes a recorded error
                        answer = f"[ERROR] {e}"
                        if any(w in str(e).lower() for w in PERMANENT):
                            break
                        time.sleep(wait * (k + 1))
                rows.append((task, model, answer, time.time() - began))
            yield pd.DataFrame(rows, columns=["task_id", "model", "response", "seconds"])

    return spread.mapInPandas(run, "task_id string, model string, response string, seconds double")
