"""Questions and explanation documents from facts and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def ask_rows(facts: DataFrame) -> DataFrame:
    """One yes/no row a fact (root, s, p, o); the answer is TRUE."""
    root, s, p, o = (F.col(c) for c in ("root", "s", "p", "o"))
    return facts.select(names.task_id(root, s, p, "BIN").alias("task_id"), "root", names.task_type(p).alias("task_type"), F.lit("BIN").alias("answer_type"), names.ask(s, p, o).alias("query"), "p", F.lit("TRUE").alias("answer"), names.triple_key(s, p, o).alias("key"))


def select_rows(facts: DataFrame, per_fact: bool = True) -> DataFrame:
    """Open rows for (root, s, p) with several objects: answers sorted and joined by '; ', once a fact as published files
    have them, or once a group."""
    groups = facts.groupBy("root", "s", "p").agg(F.array_join(F.sort_array(F.collect_set("o")), "; ").alias("answer"), F.count_distinct("o").alias("n")).where("n > 1")
    rows = facts.join(groups, ["root", "s", "p"]) if per_fact else groups.withColumn("o", F.lit(None).cast("string"))
    root, s, p = F.col("root"), F.col("s"), F.col("p")
    return rows.select(names.task_id(root, s, p, "MC").alias("task_id"), "root", names.task_type(p).alias("task_type"), F.lit("MC").alias("answer_type"), names.select(s, p).alias("query"), "p", "answer", names.triple_key(s, p, F.col("o")).alias("key"))


def first_wins(facts: DataFrame) -> DataFrame:
    """Each triple only in the first root (by name) that has it."""
    first = Window.partitionBy("s", "p", "o").orderBy("root")
    return facts.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")


def task_ids(questions: DataFrame) -> DataFrame:
    return questions.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("task_id")), ",").alias("task_ids"), F.count(F.lit(1)).alias("n"))


def explanations(tagged_paths: DataFrame, questions: DataFrame) -> DataFrame:
    """(key, document): the explanation document of every triple as JSON text."""
    key = names.triple_key(F.col("s"), F.col("p"), F.col("o"))
    one = F.concat("justifications", F.array(F.concat(F.lit("TAG:"), "tag")))
    paths = tagged_paths.groupBy("s", "p", "o").agg(F.sort_array(F.collect_list(one)).alias("explanations"), F.min("complexity").alias("least"), F.max("complexity").alias("most"), F.count(F.lit(1)).alias("n")).withColumn("key", key)
    ids = questions.groupBy("key").agg(F.sort_array(F.collect_list("task_id")).alias("taskIds"))
    many = F.exists(F.coalesce("taskIds", F.array().cast("array<string>")), lambda t: t.contains("-MC"))
    asks = F.array(names.ask(F.col("s"), F.col("p"), F.col("o")))
    queries = F.when(many, F.concat(asks, F.array(names.select(F.col("s"), F.col("p"))))).otherwise(asks)
    doc = F.struct(
        F.struct(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object")).alias("inferred"), "explanations",
        F.struct(F.col("least").alias("min"), F.col("most").alias("max")).alias("size"), F.col("n").alias("explanationCount"),
        F.coalesce("taskIds", F.array().cast("array<string>")).alias("taskIds"), queries.alias("sparqlQueries"),
    )
    return paths.join(ids, "key", "left").select("key", F.to_json(doc).alias("document"))
