"""Recorded model answers: extraction, quality heuristics, summaries; and their scoring. Column expressions throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def answer_type(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("multi choice", "mc", "multichoice"), "MC").otherwise("BIN")


#: Spellings of the two answer types (fixed values).
_BINARY = ["bin", "binary", "true/false", "true false"]
_OPEN = ["mc", "multi choice", "multiple choice", "multichoice"]


def strict_answer_type(c: Column) -> Column:
    """'binary' or 'multi choice'; any other spelling, or null, raises when its row is computed."""
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    unknown = F.raise_error(F.concat(F.lit("unknown answer type: "), F.coalesce(c, F.lit("null"))))
    return F.when(t.isin(*_BINARY), "binary").when(t.isin(*_OPEN), "multi choice").otherwise(unknown)


def final_answer(text: Column, kind: Column) -> Column:
    """The ANSWER: line, else the first line; TRUE/FALSE for yes/no questions, ERROR for failed calls."""
    line = F.regexp_extract(text, r"(?i)ANSWER:\s*([^\n]*)", 1)
    raw = F.trim(F.when(line != "", line).otherwise(F.split_part(text, F.lit("\n"), F.lit(1))))
    upper = F.upper(raw)
    binary = F.when(upper.contains("TRUE") | upper.contains("YES"), "TRUE").when(upper.contains("FALSE") | upper.contains("NO"), "FALSE").otherwise(upper)
    open_ = F.regexp_replace(F.regexp_replace(raw, r"<[^>]*[#/]([^#/>]*)>", "$1"), r"\b\w+:(\w)", "$1")
    return F.when(text.startswith("[ERROR]") | text.isNull(), "ERROR").when(kind == "BIN", binary).otherwise(open_)


def confidence(text: Column) -> Column:
    value = F.regexp_extract(text, r"(?i)CONFIDENCE:\s*([0-9]*\.?[0-9]+)", 1)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value.try_cast("double"), F.lit(0.5))))


def reasoning_steps(text: Column) -> Column:
    value = F.regexp_extract(text, r"(?i)STEPS:\s*([0-9]+)", 1).try_cast("double")
    return F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.coalesce(value, F.lit(1.0))))


def clean_items(text: Column) -> Column:
    """The set of an answer's items: split at ';' else ',', signs and years and bare numbers dropped."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    parts = F.when(t.contains(";"), F.split(t, ";")).when(t.contains(","), F.split(t, ",")).otherwise(F.array(t))

    def clean(x: Column) -> Column:
        x = F.trim(F.regexp_replace(F.trim(x), r"[_*#@$%^&()+=\[\]{}|\\:\";'<>?/~`]", ""))
        x = F.regexp_replace(F.regexp_replace(x, r"\s+\d{4}$", ""), r"\s+\d{4}\s+", " ")
        x = F.regexp_replace(F.regexp_replace(x, r"^\d+$", ""), r"[^a-z0-9\s]", "")
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    return F.array_distinct(F.filter(F.transform(parts, clean), lambda x: x != ""))


def accuracy(expected: Column, actual: Column, kind: Column) -> Column:
    """Jaccard of the cleaned sets; 1 for two empty ones, 0 for one; all or nothing for yes/no."""
    a, b = clean_items(expected), clean_items(actual)
    j = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    score = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(j)
    return F.when(kind == "BIN", F.when(score == 1.0, 1.0).otherwise(0.0)).otherwise(score)


def calibration(conf: Column, score: Column) -> Column:
    """1 - |confidence - correct|; an empty confidence counts as 1, as published scores have it."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(conf, F.lit(1.0))))
    return 1 - F.abs(c - F.when(score >= 1.0, 1.0).otherwise(0.0))


def parse_answers(text: Column) -> Column:
    t = F.lower(F.trim(text))
    parts = F.when(t.contains(";"), F.split(t, ";")).when(t.contains(","), F.split(t, ",")).when(t.contains("\n"), F.split(t, "\n")).otherwise(F.array(t))
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"[^\w\s]", ""), r"\s+", " "))), lambda x: x != "")


def hallucination(expected: Column, actual: Column, kind: Column) -> Column:
    """Share of given answers that match no valid one (equal, containing or contained, or equal without spaces); a rate,
    null for yes/no, 1 without an answer."""
    given, valid = parse_answers(actual), parse_answers(expected)
    bare = lambda x: F.regexp_replace(x, " ", "")
    wrong = F.filter(given, lambda g: ~F.exists(valid, lambda v: (g == v) | g.contains(v) | v.contains(g) | (bare(g) == bare(v))))
    return F.when(kind != "BIN", F.when(F.size(given) == 0, 1.0).otherwise(F.size(wrong) / F.size(given)))


def usable(answer: Column) -> Column:
    return answer.isNotNull() & (F.trim(answer) != "") & ~answer.startswith("[ERROR]") & (answer != "ERROR")


def summary(scored: DataFrame) -> DataFrame:
    """Overall and per answer type in one pass (grouping sets): scored(model, answer_type, score). A null type is a type of
    its own; 'ALL' is the overall row."""
    s = F.col("score")
    grouped = scored.groupingSets([["model"], ["model", "answer_type"]], "model", "answer_type")
    return grouped.agg(
        F.grouping("answer_type").alias("_all"), F.count(F.lit(1)).alias("n"), F.count(F.when(s >= 1, 1)).alias("perfect"), F.count(F.when((s > 0) & (s < 1), 1)).alias("partial"),
        F.count(F.when(s <= 0, 1)).alias("wrong"), F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_pop(s), 6).alias("std"),
    ).select("model", F.when(F.col("_all") > 0, "ALL").otherwise(F.col("answer_type")).alias("answer_type"), "n", "perfect", "partial", "wrong", "mean", "std")


def rank_sum(scores: DataFrame) -> DataFrame:
    """Mann-Whitney U of every pair of models from scores(model, score): average ranks by equal values, no row-wise ranks.

    Values are aggregated first (models x distinct values), so the windows run over distinct values only.
    """
    counts = scores.groupBy("model", "score").agg(F.count(F.lit(1)).alias("n"))
    a = counts.select(F.col("model").alias("a"), F.col("score").alias("v"), F.col("n").alias("na"))
    b = counts.select(F.col("model").alias("b"), F.col("score").alias("v"), F.col("n").alias("nb"))
    models = counts.groupBy("model").agg(F.sum("n").alias("total"))
    pairs = models.select(F.col("model").alias("a"), F.col("total").alias("ta")).join(models.select(F.col("model").alias("b"), F.col("total").alias("tb")), F.col("a") < F.col("b"))
    wide = pairs.select("a", "b").join(counts.select("model", F.col("score").alias("v")).distinct(), (F.col("model") == F.col("a")) | (F.col("model") == F.col("b"))).select("a", "b", "v").distinct()
    wide = wide.join(a, ["a", "v"], "left").join(b, ["b", "v"], "left").na.fill(0, ["na", "nb"])
    below = F.coalesce(F.sum("nb").over(Window.partitionBy("a", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = wide.withColumn("below", below).groupBy("a", "b").agg(F.sum(F.col("na") * (F.col("below") + F.col("nb") / 2.0)).alias("u"))
    return pairs.join(u, ["a", "b"]).select("a", "b", F.col("ta").alias("n_a"), F.col("tb").alias("n_b"), F.col("u").alias("u"))


def rank_test(scores: DataFrame, least: int = 30) -> DataFrame:
    """rank_sum with mean difference, two-sided p-value (normal approximation with tie and continuity correction) and
    stars; null where a model has `least` scores or fewer. Python sees one row a pair of models."""
    counts = scores.groupBy("model", "score").agg(F.count(F.lit(1)).alias("n"))
    means = counts.groupBy("model").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"))
    u = rank_sum(scores)
    pairs = u.select("a", "b").join(counts.select("model", "score", "n"), (F.col("model") == F.col("a")) | (F.col("model") == F.col("b"))).groupBy("a", "b", "score").agg(F.sum("n").alias("t"))
    ties = pairs.groupBy("a", "b").agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    j = u.join(ties, ["a", "b"]).join(means.select(F.col("model").alias("a"), F.col("mean").alias("ma")), "a").join(means.select(F.col("model").alias("b"), F.col("mean").alias("mb")), "b")
    n = F.col("n_a") + F.col("n_b")
    variance = F.col("n_a") * F.col("n_b") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    top = F.greatest(F.col("u"), F.col("n_a") * F.col("n_b") - F.col("u"))
    z = F.when(variance > 0, (top - F.col("n_a") * F.col("n_b") / 2.0 - 0.5) / F.sqrt(variance)).otherwise(0.0)

    @F.pandas_udf("double")
    def two_sided(z):
        from math import erfc, sqrt

        return z.map(lambda x: min(1.0, erfc(x / sqrt(2))))

    p = F.when((F.col("n_a") > least) & (F.col("n_b") > least), two_sided(z))
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")
    return j.select("a", "b", "n_a", "n_b", "u", (F.col("ma") - F.col("mb")).alias("mean_difference"), p.alias("p_value"), stars.alias("significance"))


#: Values seen up to this often are drawn from tables of the Poisson distribution, others by its normal limit.
TABLED = 20


def poisson_table(n: int) -> list[float]:
    """Chances of up to 0, 1, 2, ... when n are expected, until a 32-bit draw can't lie above."""
    out, term = [], math.exp(-n)
    while not out or out[-1] < 1 - 2.0**-34:
        out.append((out[-1] if out else 0.0) + term)
        term *= n / len(out)
        if term < 1e-18 and len(out) > n:
            break
    return out


def bootstrap(scores: DataFrame, resamples: int = 1000, seed: int = 42, least: int = 30) -> DataFrame:
    """(model, mean, low, high): percentile interval from resampling scores(model, score); null with `least` scores or
    fewer.

    Rows are first aggregated to distinct values with counts. In a resample every row is drawn a Poisson number of times, one
    expected, so a value seen n times is drawn Poisson(n) times: the number is read off the distribution function by an
    md5-seeded draw (above TABLED its normal limit, rounded), so nothing is collected and reruns agree on any engine. The work
    is values x resamples in the tasks that hold them; what is shuffled is a row a model and resample from each.
    """
    spark = scores.sparkSession
    counts = scores.groupBy("model", F.col("score").cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    tables = F.broadcast(spark.createDataFrame([(n, poisson_table(n)) for n in range(1, TABLED + 1)], "n0 long, upto array<double>"))  # TABLED rows
    k = counts.join(tables, F.col("n") == F.col("n0"), "left").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    name = F.concat_ws("|", F.lit(seed).cast("string"), "model", F.round(F.col("score") * 1e9).cast("long").cast("string"), F.col("k").cast("string"))
    u = lambda at: (F.conv(F.substring(F.md5(name), at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(9))
    drawn = k.withColumn("u", u(1)).withColumn("w", F.when(F.col("upto").isNull(), F.greatest(F.lit(0.0), F.round(F.col("n") + F.sqrt("n") * normal))).otherwise(F.size(F.filter("upto", lambda c: c < F.col("u"))).cast("double")))
    means = drawn.groupBy("model", "k").agg(F.try_divide(F.sum(F.col("score") * F.col("w")), F.sum("w")).alias("m"), F.sum("n").alias("n"))
    keep = lambda c: F.when(F.max("n") > least, c)
    return means.groupBy("model").agg(keep(F.avg("m")).alias("mean"), keep(F.percentile("m", 0.025)).alias("low"), keep(F.percentile("m", 0.975)).alias("high"))


#: Words and signs of reasoning (fixed values).
_BULLETS = ["•", "-", "*", "1.", "2.", "3."]
_REASONS = ["because", "therefore", "since", "thus", "shows", "indicates"]


def quality(response: Column, expected: Column, extracted: Column, kind: Column) -> dict[str, Column]:
    """Heuristic marks of a response: correctness, completeness (by number of words), structure_compliance,
    reasoning_quality; all 0 for an empty or null response."""
    want, got = F.lower(F.trim(F.coalesce(expected, F.lit("none")))), F.lower(F.trim(F.coalesce(extracted, F.lit("none"))))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\w+)\b"), 1))
    a, b = words(want), words(got)
    jaccard = F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
    correct = F.when(kind == "BIN", (want == got).cast("double")).when(kind == "MC", F.when(got.contains(want) | want.contains(got), 1.0).otherwise(jaccard)).otherwise(0.0)
    n = F.size(F.filter(F.split(response, r"\s+"), lambda x: x != ""))
    complete = F.when(n > 50, 0.6).when(n >= 20, 1.0).when(n >= 10, 0.8).otherwise(0.3)
    part = lambda word: response.rlike(rf"(?i){word}:\s*[^\n]+").cast("int")
    total = lambda text, items, each: sum((text.contains(x).cast("int") for x in items), F.lit(0)) * each
    reasons = F.least(F.lit(1.0), total(response, _BULLETS, 0.3) + total(F.lower(response), _REASONS, 0.2))
    marks = {"correctness": correct, "completeness": complete, "structure_compliance": (part("ANSWER") + part("REASONING")) * 0.5, "reasoning_quality": reasons}
    return {k: F.when(F.coalesce(response, F.lit("")) == "", 0.0).otherwise(v) for k, v in marks.items()}


def valid_entities(context: Column, expected: Column) -> Column:
    """The expected answers and every individual, class name and IRI's name in the context, lower-cased, sorted."""
    c = F.coalesce(context, F.lit(""))
    found = lambda text, form, g=0: F.transform(F.regexp_extract_all(text, F.lit(form), g), F.lower)
    return F.sort_array(F.array_distinct(F.concat(parse_answers(F.coalesce(expected, F.lit(""))), found(F.lower(c), r"\b[a-z]+(?:_[a-z]+)*_\d{4}\b"), found(c, r"\b[A-Z][a-zA-Z]+\b"), found(c, r"<[^>]+#([^>]+)>", 1))))


def succeeded(score: Column, threshold: Column, is_rate: Column) -> Column:
    """Whether a metric's score reaches its threshold; a rate succeeds at or below it."""
    return F.when(is_rate, score <= threshold).otherwise(score >= threshold)


def models_of(columns: list[str]) -> list[str]:
    """Models of a wide table of answers: its columns that end in _final_answer."""
    return sorted(c.removesuffix("_final_answer") for c in columns if c.endswith("_final_answer"))


def long_answers(wide: DataFrame, key: str, measures: tuple[str, ...] = ("final_answer",)) -> DataFrame:
    """(key, model, measures...) of a wide table with one column a model and measure; missing columns are null."""
    rows = [F.struct(F.lit(m).alias("model"), *((F.col(f"{m}_{x}").cast("string") if f"{m}_{x}" in wide.columns else F.lit(None).cast("string")).alias(x) for x in measures)) for m in models_of(wide.columns)]
    return wide.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def shortest_tags(explanations: DataFrame) -> DataFrame:
    """(query, key, tag): the shortest tag, 'D' left out, among explanations whose third element is the tag."""
    tags = F.transform(F.filter("explanations", lambda e: F.try_element_at(e, F.lit(3)).startswith("TAG:")), lambda e: F.regexp_replace(F.regexp_replace(F.element_at(e, 3), "^TAG:", ""), "D", ""))
    best = F.array_min(F.transform(tags, lambda t: F.named_struct(F.lit("n"), F.length(t), F.lit("t"), t)))["t"]
    return explanations.select(F.explode("sparqlQueries").alias("query"), "key", best.alias("tag"))


def fuzzy_queries(queries: DataFrame, index: DataFrame, least: float = 0.9) -> DataFrame:
    """(query, match): the first index query (by text) with token-set Jaccard of `least` or more.

    Exact prefix filter: sets that similar share one of the first |x| - ceil(least * |x|) + 1 tokens in a common order, so
    only pairs with a prefix token in common are compared; rare tokens come first in the order.
    """
    tokens = lambda c: F.array_distinct(F.split(F.trim(c), r"\s+"))
    a, b = queries.select("query", tokens(F.col("query")).alias("a")).distinct(), index.select(F.col("query").alias("match"), tokens(F.col("query")).alias("b")).distinct()
    counts = a.select(F.explode("a").alias("t")).union(b.select(F.explode("b"))).groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(df: DataFrame, name: str, arr: str) -> DataFrame:
        e = df.select(name, F.size(arr).alias("size"), F.explode(arr).alias("t")).join(counts, "t")
        rank = F.row_number().over(Window.partitionBy(name).orderBy("n", "t"))
        return e.withColumn("r", rank).where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select(name, "t")

    pairs = prefixes(a, "query", "a").join(prefixes(b, "match", "b"), "t").select("query", "match").distinct()
    j = pairs.join(a, "query").join(b, "match")
    good = j.where(F.size(F.array_intersect("a", "b")) >= least * F.size(F.array_union("a", "b")))
    return good.groupBy("query").agg(F.min("match").alias("match"))


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """`df` itself; raises ValueError, naming what is missing, before any row is read."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def completed(responses: DataFrame, key: str, models: list[str]) -> DataFrame:
    """(key, answered, complete): number of `models` with a response that is not empty (repeats count once), and whether
    all have one. Null responses and other models count for nothing."""
    told = F.when(F.col("model").isin(*models) & (F.col("response") != ""), F.col("model"))
    rows = responses.groupBy(key).agg(F.count_distinct(told).alias("answered"))
    return rows.withColumn("complete", F.col("answered") == len(set(models)))


#: Columns of the short metric record (fixed values).
_ESSENTIAL = ["query_index", "model_display_name", "final_answer_extracted", "quality_correctness", "response_time_seconds", "error_occurred"]


def essential(metrics: DataFrame) -> DataFrame:
    """The short record of each metric row; a column that is not there is null."""
    return metrics.select(*(F.col(c) if c in metrics.columns else F.lit(None).cast("string").alias(c) for c in _ESSENTIAL))


def percent(c: Column, signed: bool = False) -> Column:
    """A share as percentage text with one decimal, halves to even; with a sign if `signed`; null stays null."""
    return percentage(c.cast("double") * 100, signed)


def percentage(c: Column, signed: bool = False) -> Column:
    """A percentage as text with one decimal, as printf and Python write it: the double itself is rounded, not its shortest
    decimal, true halves go to even, and what rounds to zero from below keeps its sign ('-0.0%')."""
    c = c.cast("double")
    size = F.abs(c)
    part = size % 1.0  # exact, as are 8 and 2 times it; what their sum loses is `lost`
    tens = part * 8 + part * 2
    lost = (part * 8 - tens) + part * 2
    down = F.floor(tens)
    over = (tens - down - 0.5) + lost
    digit = down + F.when((over > 0) | ((over == 0) & (down % 2 == 1)), 1).otherwise(0)
    whole = size - part + F.when(digit == 10, 1.0).otherwise(0.0)
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("+" if signed else "")
    finite = ~F.isnan(c) & (size != float("inf"))
    text = F.when(finite, F.concat(sign, F.format_string("%.0f", whole), F.lit("."), (digit % 10).cast("string"), F.lit("%")))
    return F.when(c.isNotNull(), text.otherwise(F.concat(F.when(F.isnan(c), "+nan" if signed else "nan").otherwise(F.concat(sign, F.lit("inf"))), F.lit("%"))))


def interval_texts(intervals: DataFrame) -> DataFrame:
    """bootstrap's rows as texts: (model, mean_accuracy, confidence_interval_lower, confidence_interval_upper,
    margin_of_error), the margin being half of the interval; null where there is no interval."""
    margin = (F.col("high") - F.col("low")) / 2
    return intervals.select("model", percent(F.col("mean")).alias("mean_accuracy"), percent(F.col("low")).alias("confidence_interval_lower"), percent(F.col("high")).alias("confidence_interval_upper"), percent(margin).alias("margin_of_error"))
