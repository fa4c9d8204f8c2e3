"""Names, sentences and descriptions in plain English; abstraction of named terms."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import saved
from . import numbering


def clean_name(c: Column) -> Column:
    """A readable name: trailing year, number or version dropped, camel case and signs split, capitalised."""
    x = F.regexp_replace(c, r"_\d{4}$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"_\d+$", ""), r"_v\d+$", "")
    x = F.regexp_replace(x, r"([a-z])([A-Z])", "$1 $2")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"[_\-]+", " "), r"\s+", " "))
    return F.initcap(F.lower(x))


def property_name(c: Column) -> Column:
    x = F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(x, r"[_\-]+", " ")))


def base_relation(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(property_name(c), r"^(has|is) ", ""), r" of$", ""))


def listed(items: Column) -> Column:
    """'a', 'a and b', 'a, b, and c'; empty for no items or null."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(F.lit(1), n - 1)), ", ")
    return F.when(n == 1, F.try_element_at(items, F.lit(1))).when(n == 2, F.concat_ws(" and ", items)).when(n > 2, F.concat(head, F.lit(", and "), F.try_element_at(items, F.lit(-1)))).otherwise("")


def sentence(s: Column, p: Column, objects: Column) -> Column:
    """has X, is Y of, or a plain verb."""
    name = property_name(p)
    base = base_relation(p)
    return (
        F.when(name.startswith("has "), F.concat(s, F.lit(" has "), base, F.lit(" "), listed(objects), F.lit(".")))
        .when(name.startswith("is ") & name.endswith(" of"), F.concat(s, F.lit(" is the "), base, F.lit(" of "), listed(objects), F.lit(".")))
        .otherwise(F.concat(s, F.lit(" "), name, F.lit(" "), listed(objects), F.lit(".")))
    )


def individual_text(facts: DataFrame, most: int = 5) -> DataFrame:
    """(i, text): one sentence an outgoing property, and one an incoming property that isn't also outgoing."""
    out = facts.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("os")).select(F.col("s").alias("i"), "p", sentence(F.col("s"), F.col("p"), F.col("os")).alias("t"), F.lit(0).alias("k"))
    first = F.row_number().over(Window.partitionBy("o", "p").orderBy("s"))
    near = facts.withColumn("r", first).where(F.col("r") <= most)
    into = near.groupBy("o", "p").agg(F.sort_array(F.collect_list("s")).alias("ss")).join(facts.select(F.col("s").alias("o"), "p").distinct(), ["o", "p"], "left_anti")
    into = into.select(F.col("o").alias("i"), "p", F.concat(F.col("o"), F.lit(" is reached by "), property_name(F.col("p")), F.lit(" from "), listed(F.col("ss")), F.lit(".")).alias("t"), F.lit(1).alias("k"))
    return out.unionByName(into).groupBy("i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "p", "t"))), lambda x: x["t"]), " ").alias("text"))


def structural_type(classes: Column, properties: Column, individuals: Column, sub_classes: Column) -> Column:
    return F.when(sub_classes > 10, "hierarchical").when(properties > 20, "relational").when(individuals > 50, "instance_heavy").otherwise("general")


def resolve_overlap(terms: DataFrame) -> DataFrame:
    """(term, category): class before object property before data property before individual."""
    order = F.when(F.col("category") == "class", 1).when(F.col("category") == "object property", 2).when(F.col("category") == "data property", 3).otherwise(4)
    return terms.groupBy("term").agg(F.min_by("category", order).alias("category"))


def numbered(terms: DataFrame) -> DataFrame:
    """(category, term, abstract): numbered by name within the category, categories of any size over all tasks."""
    prefix = F.when(F.col("category") == "class", "Class").when(F.col("category") == "object property", "Property").when(F.col("category") == "data property", "DataProperty").otherwise("Individual")
    placed = numbering.numbered(terms, ["category"], ["term"], "_place")
    return placed.withColumn("abstract", F.concat(prefix, (F.col("_place") + 1).cast("string"))).drop("_place")


def by_text(texts: DataFrame, key: str, text: str, rewritten) -> DataFrame:
    """(key, text) of every row of texts after `rewritten`, which maps a table (h, text) of distinct texts to (h, new).

    What becomes of a text depends on nothing else, so each is rewritten once, rows of one key stay apart, repeated rows
    count each, and null texts stay null.
    """
    rows = texts.select(key, F.col(text).alias("_text"), F.sha2(F.col(text), 256).alias("_h"))
    new = rewritten(rows.where("_h IS NOT NULL").groupBy("_h").agg(F.first("_text").alias("text")).withColumnRenamed("_h", "h"))
    return rows.join(new, F.col("_h") == F.col("h"), "left").select(key, F.col("new").alias(text))


def least_names(mapping: DataFrame) -> DataFrame:
    """(term, abstract): the least name of a term that has several."""
    return mapping.groupBy("term").agg(F.min("abstract").alias("abstract"))


def rewrite(texts: DataFrame, mapping: DataFrame, key: str, text: str) -> DataFrame:
    """Replaces whole words of `text` by their abstract names: words are joined with the mapping, so its size is free.

    Every row gives one row; null texts stay null; of a term's names the least is taken.
    """
    names = least_names(mapping).select(F.col("term").alias("w"), "abstract")

    def new(distinct: DataFrame) -> DataFrame:
        words = distinct.select("h", F.posexplode(F.split("text", r"(?<=\W)|(?=\W)")).alias("n", "w")).join(names, "w", "left")
        bits = F.sort_array(F.collect_list(F.struct("n", F.coalesce("abstract", "w").alias("w"))))
        return words.groupBy("h").agg(F.array_join(F.transform(bits, lambda x: x["w"]), "").alias("new"))

    return by_text(texts, key, text, new)


def phrases(mapping: DataFrame, most: int = 5_000) -> dict[str, str]:
    """The mapping of one terminology as a dict, empty terms left out, the least name of a term that has several. It goes
    into an expression, so more than `most` terms raise (`rewrite` joins, for mappings of single words of any size)."""
    rows = mapping.where("term <> ''").groupBy("term").agg(F.min("abstract").alias("abstract")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms to replace")
    return {r["term"]: r["abstract"] for r in rows}


def replace_phrases(text: Column, names: dict[str, str]) -> Column:
    """`text` with every term, of one word or several, replaced by its name in one pass from left to right, longer terms
    first, never inside a word; a null text gives an empty one."""
    text = F.coalesce(text, F.lit(""))
    if not names:
        return text
    terms = sorted(names, key=lambda t: (-len(t), t))
    form = rf"(?U)(?<!\w)(?:{'|'.join(map(re.escape, terms))})(?!\w)|\w+|\W"
    lookup = F.create_map(*(F.lit(x) for t in terms for x in (t, names[t])))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda w: F.coalesce(F.try_element_at(lookup, w), w)), "")


def _tokens(text: Column) -> Column:
    """Words, and every other character by itself."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|\W"), F.lit(0))


def rewrite_phrases(texts: DataFrame, mapping: DataFrame, key: str, text: str) -> DataFrame:
    """`replace_phrases` for mappings of any size: (key, text), each term of one word or several replaced by its least name, in
    one pass from left to right, longer terms first, never inside a word. Every row gives one row; null texts become empty.

    The terms' prefixes, word by word, are a table of (hash of the prefix, next word, hash of the longer one). Matches grow by
    one join a word, from every place of every distinct text, and only those that are still the start of a term go on, so
    there are as many joins as the longest term has words. Of a text's matches those that overlap none before them are kept.
    """
    mark, is_word = "\u0001", lambda w: w.rlike(r"(?U)^\w")
    named = least_names(mapping.where("term <> '' AND abstract IS NOT NULL")).select("abstract", _tokens(F.col("term")).alias("t"))
    chain = F.transform("t", lambda w, k: F.struct(k.alias("k"), w.alias("w"), F.sha2(F.array_join(F.slice("t", 1, k), mark), 256).alias("before"), F.sha2(F.array_join(F.slice("t", 1, k + 1), mark), 256).alias("upto")))
    steps = named.select("abstract", F.size("t").alias("m"), F.explode(chain).alias("x")).select("x.*", F.when(F.col("x.k") == F.col("m") - 1, F.col("abstract")).alias("abstract"))
    steps = saved(steps.groupBy("k", "w", "before", "upto").agg(F.max("abstract").alias("abstract")), "phrases")
    longest = (steps.agg(F.max("k")).first()[0] or 0) + 1

    def new(distinct: DataFrame) -> DataFrame:
        t = distinct.withColumn("t", _tokens(F.col("text")))
        words = t.select("h", F.posexplode("t").alias("n", "w"), "t").select("h", "n", "w", F.when(F.col("n") > 0, F.element_at("t", F.greatest(F.col("n"), F.lit(1)))).alias("prev"), F.try_element_at("t", F.col("n") + 2).alias("next"))
        words = saved(words, "phrase-words")
        ended = is_word(F.col("w")) | ~F.coalesce(is_word(F.col("next")), F.lit(False))
        here = steps.where("k = 0").select("w", "upto", "abstract")
        begun = is_word(F.col("w")) | ~F.coalesce(is_word(F.col("prev")), F.lit(False))
        open_ = words.join(here, "w").select("h", "n", F.when(begun, F.col("upto")).alias("upto"), "abstract")  # one token is never part of a word
        found = []
        for k in range(1, longest + 1):
            open_ = saved(open_, "phrase-matches")
            found.append(open_.where("abstract IS NOT NULL").select("h", "n", F.lit(k).alias("len"), "abstract"))
            if k == longest or open_.isEmpty():
                break
            after = words.select(F.col("h").alias("h2"), F.col("n").alias("n2"), "w", "next")
            grown = open_.where("upto IS NOT NULL").select("h", "n", F.col("upto").alias("at")).join(after, (F.col("h") == F.col("h2")) & (F.col("n") + k == F.col("n2")))
            open_ = grown.join(steps.where(F.col("k") == k).select(F.col("w").alias("w2"), "before", "upto", "abstract"), (F.col("w") == F.col("w2")) & (F.col("at") == F.col("before"))).select("h", "n", "upto", F.when(ended, F.col("abstract")).alias("abstract"))
        matches = reduce(DataFrame.unionByName, found).groupBy("h", "n").agg(F.max(F.struct("len", "abstract")).alias("m"))
        each = matches.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("n", "m.len", "m.abstract"))).alias("ms"))
        start = F.struct(F.lit(0).alias("end"), F.filter("ms", lambda x: F.lit(False)).alias("kept"))
        kept = F.aggregate("ms", start, lambda a, x: F.when(x["n"] >= a["end"], F.struct((x["n"] + x["len"]).alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a))["kept"]
        spans = each.select("h", F.explode(kept).alias("x")).select("h", F.posexplode(F.sequence("x.n", F.col("x.n") + F.col("x.len") - 1)).alias("j", "n3"), F.col("x.abstract").alias("name"))
        spans = spans.select(F.col("h").alias("h3"), "n3", F.when(F.col("j") == 0, F.col("name")).otherwise("").alias("put"))
        bits = words.join(spans, (F.col("h") == F.col("h3")) & (F.col("n") == F.col("n3")), "left").select("h", "n", F.coalesce("put", "w").alias("w"))
        return bits.groupBy("h").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]), "").alias("new"))

    out = by_text(texts.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)), key, text, new)
    return out.withColumn(text, F.coalesce(text, F.lit("")))  # an empty text has no words
