"""Files between stages: question tables, explanation documents (also cut-off ones), mappings, modules, benchmarks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION_COLUMNS = ["Task ID", "Root Entity", "Size of ontology TBox", "Size of ontology ABox", "Task Type", "Answer Type", "SPARQL Query", "Predicate", "Answer", "Min Tag Length", "Max Tag Length"]
EXPLANATION = "inferred struct<subject:string,predicate:string,object:string>, explanations array<array<string>>, size struct<min:int,max:int>, explanationCount int, taskIds array<string>, sparqlQueries array<string>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    kinds = ", ".join(f"`{c}` {'int' if c.startswith(('Size', 'Min', 'Max')) else 'string'}" for c in QUESTION_COLUMNS)
    return spark.read.schema(kinds).csv(path, header=True, quote='"', escape='"', multiLine=True)


def write_questions(questions: DataFrame, path: str) -> None:
    """Appends; line breaks inside a value become spaces, strings are quoted."""
    clean = [F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"[\r\n]+", " ").alias(c) if t == "string" else F.col(f"`{c}`") for c, t in questions.dtypes]
    questions.select(clean).write.mode("append").csv(path, header=True, quote='"', escape='"', quoteAll=True)


def leading_entries(text: str) -> list[tuple[str, str]]:
    """(key, value as JSON) of a JSON object's complete leading entries, of a cut-off one too."""
    decoder, out = json.JSONDecoder(), []
    at = text.find("{") + 1
    while at > 0:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text) or text[at] == "}":
            break
        try:
            key, at = decoder.raw_decode(text, at)
            while text[at] in " \t\r\n:":
                at += 1
            value, at = decoder.raw_decode(text, at)
        except (ValueError, IndexError):
            break
        out.append((str(key), json.dumps(value, ensure_ascii=False)))
    return out


def read_explanations(spark: SparkSession, path: str) -> DataFrame:
    """(key, and the fields of EXPLANATION), one row a triple, from one JSON object a file."""
    texts = spark.read.text(path, wholetext=True)

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame([e for t in pdf.value for e in leading_entries(t)], columns=["key", "document"])

    rows = texts.mapInPandas(run, "key string, document string")
    return rows.select("key", F.from_json("document", EXPLANATION).alias("e")).select("key", "e.*")


def write_explanations(documents: DataFrame, path: str) -> None:
    """One line a triple: {"key": ..., "document": {...}} as text."""
    line = F.concat(F.to_json(F.struct("key")).substr(F.lit(1), F.length(F.to_json(F.struct("key"))) - 1), F.lit(',"document":'), "document", F.lit("}"))
    documents.select(line.alias("value")).write.mode("append").text(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(term, abstract) of 'name -> <iri#Abstract>' lines; headings and blank lines are skipped."""
    line = F.trim("value")
    parts = F.split(line, "->", 2)
    return spark.read.text(path).where(~line.startswith("=") & line.contains("->")).select(F.trim(parts.getItem(0)).alias("term"), F.regexp_extract(F.trim(parts.getItem(1)), "#([^>]*)", 1).alias("abstract"))


#: Headings of a mapping file and the categories below them (fixed values).
SECTIONS = [("class", "=== CLASSES ==="), ("object property", "=== OBJECT PROPERTIES ==="), ("data property", "=== DATA PROPERTIES ==="), ("individual", "=== INDIVIDUALS ===")]


def mapping_lines(numbered: DataFrame, base: str = "http://www.example.com/abstracted.owl#") -> DataFrame:
    """(value) of a mapping file in order: each category's heading, then 'name -> <iri>' lines by name."""
    spark = numbered.sparkSession
    heads = spark.createDataFrame([(k, c, h) for k, (c, h) in enumerate(SECTIONS)], "k int, category string, value string")
    lines = numbered.join(F.broadcast(heads.select("k", "category")), "category").select("k", F.lit(1).alias("m"), "term", F.concat("term", F.lit(f" -> <{base}"), "abstract", F.lit(">")).alias("value"))
    titles = heads.select("k", F.lit(0).alias("m"), F.lit("").alias("term"), "value")
    return titles.unionByName(lines).orderBy("k", "m", "term").select("value")


def write_mapping(numbered: DataFrame, path: str, base: str = "http://www.example.com/abstracted.owl#") -> None:
    """Part files that hold the sectioned lines in order, one after the other by name."""
    mapping_lines(numbered, base).write.mode("overwrite").text(path)


def read_texts(spark: SparkSession, path: str, suffix: str = "ttl") -> DataFrame:
    """(path, text): every file below path, at any depth, whose name ends in the suffix, in either case."""
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{either}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_abstracted(texts: DataFrame, path: str) -> None:
    """(graph_id, text): rewritten Turtle, one folder a graph."""
    texts.select("graph_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("graph_id").text(path)


VERBALISED = "ontology struct<name:string,structuralType:string,triples:long,description:string>, classes array<struct<classLabel:string,description:string>>, objectProperties array<struct<propertyLabel:string,description:string>>, dataProperties array<struct<propertyLabel:string,description:string>>, individuals array<struct<individualLabel:string,description:string>>"


def verbalised(names: DataFrame, entries: DataFrame) -> DataFrame:
    """One document an ontology from names(graph_id, name, structuralType, triples, description) and entries(graph_id, part,
    label, text), part one of class, object property, data property, individual; entries by label. One ontology's
    description is one value, as its file is: it must fit a task."""
    def part(kind: str, label: str):
        picked = F.filter("all", lambda e: e["part"] == kind)
        return F.transform(picked, lambda e: F.struct(e["label"].alias(label), e["text"].alias("description")))

    each = entries.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("part", "label", "text"))).alias("all"))
    joined = names.join(each, "graph_id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<part:string,label:string,text:string>>")))
    return joined.select("graph_id", F.struct("name", "structuralType", "triples", "description").alias("ontology"), part("class", "classLabel").alias("classes"), part("object property", "propertyLabel").alias("objectProperties"), part("data property", "propertyLabel").alias("dataProperties"), part("individual", "individualLabel").alias("individuals"))


def write_json(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with nulls kept, one document a line: verbalised ontologies, benchmarks, findings, metadata."""
    documents.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_verbalised(spark: SparkSession, path: str) -> DataFrame:
    """Verbalised ontologies with their file's name: JSON lines, or one document a file."""
    return spark.read.schema(VERBALISED).json(path, multiLine=False).withColumn("path", F.col("_metadata.file_path"))


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Samples, conversions and results as quoted CSV with a header; null is an empty field."""
    rows.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def write_checkpoint(answers: DataFrame, path: str, run: str) -> None:
    """Answers of a run so far, in a folder of the run's own; a repeated run replaces its own rows only."""
    answers.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Answers of all runs; of a task's repeated answers that of the last run by name."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in ("task_id", "model")]
    last = rows.groupBy("task_id", "model").agg(F.max_by(F.struct(*values), "run").alias("last"))
    return last.select("task_id", "model", "last.*")


def findings(summary: DataFrame) -> DataFrame:
    """Key findings from summary(model, answer_type, n, perfect, partial, wrong, mean, std): numbers as shown, in percent
    with one decimal."""
    shown = lambda c: F.format_string("%.1f%%", 100.0 * F.col(c))
    rate = lambda c: F.format_string("%.1f%%", F.when(F.col("n") > 0, 100.0 * F.col(c) / F.col("n")).otherwise(0.0))
    return summary.select("model", "answer_type", F.col("n").cast("string").alias("cases"), rate("perfect").alias("perfect"), rate("partial").alias("partial"), rate("wrong").alias("wrong"), shown("mean").alias("mean"), shown("std").alias("std"))


def turtle_lines(facts: DataFrame) -> DataFrame:
    """(graph_id, value): Turtle statements of triples(graph_id, s, p, o, o_kind, o_dtype, o_lang)."""
    node = lambda c: F.when(c.startswith("_:"), F.regexp_replace(c, r"[^\w:.\-]", "_")).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    literal = F.when(F.col("o_lang").isNotNull(), F.concat(text, F.lit("@"), "o_lang")).when(F.col("o_dtype").isNotNull(), F.concat(text, F.lit("^^<"), "o_dtype", F.lit(">"))).otherwise(text)
    return facts.select("graph_id", F.concat_ws(" ", node(F.col("s")), node(F.col("p")), F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o"))), F.lit(".")).alias("value"))


def module_name(kinds: F.Column, root: F.Column) -> F.Column:
    """Name of a root's module: its first two types by name, joined, then the root; Thing without types."""
    first = F.slice(F.sort_array(F.array_distinct(kinds)), 1, 2)
    return F.concat(F.when(F.size(first) > 0, F.array_join(first, "_")).otherwise("Thing"), F.lit("_"), root)


def write_modules(facts: DataFrame, path: str, base: str = "http://example.org/extracted/") -> None:
    """One folder of Turtle a graph, each with a statement that names its ontology."""
    head = facts.select("graph_id").distinct().select("graph_id", F.concat(F.lit(f"<{base}"), "graph_id", F.lit("> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2002/07/owl#Ontology> .")).alias("value"))
    turtle_lines(facts).unionByName(head).write.mode("overwrite").partitionBy("graph_id").text(path)


def benchmark_entries(questions: DataFrame) -> DataFrame:
    """Final benchmark: questions of one task type, answer type, root and context as one entry with its list of QAs."""
    keys = ["Task Type", "Answer Type", "Root Entity", "NL Context"]
    qa = F.struct("SPARQL Query", "NL Question", "Answer")
    whole = questions.where(" and ".join(f"`{k}` is not null" for k in keys))
    return whole.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.sort_array(F.collect_list(qa)).alias("QAs"))
