"""Abstraction of named terms: how a text names things, what its terms are, and rewriting them to abstract names.

Texts come as rows (key, text). Defined cases: null and empty texts have no terms and are rewritten to an empty text;
repeated rows count each; a text without enough names of one kind is in mode 'unknown'.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verbal import by_text, least_names

#: Prefixes and namespaces of the standards (fixed values).
STANDARD_PREFIXES = ["rdf", "rdfs", "owl", "xsd", "xml"]
STANDARD_URIS = ["www.w3.org/2002/07/owl", "www.w3.org/2000/01/rdf-schema", "www.w3.org/1999/02/22-rdf-syntax"]
#: Forms of names that tell individuals and properties (fixed values).
INDIVIDUAL_NAMES = r"^[UPC][0-9]|[0-9]+$"
PROPERTY_NAMES = r"(?i)^(has|is|can|should|get|set)|(Of|For|By|To|From|With)$|^(advises|enrolls|teaches|offer|takes)|^[a-z]"
_NOT_TERMS = ["class", "property", "type", "thing"]


def modes(texts: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """(key, mode, target): 'prefix' with the commonest prefix of more than `most` names (ns1 before any other), 'uri' with
    the commonest namespace, or 'unknown'; ties go to the first by name."""
    t = F.coalesce(F.col(text), F.lit(""))
    prefixes = F.filter(F.regexp_extract_all(t, F.lit(r"\b(\w+):[A-Za-z][A-Za-z0-9_]*\b"), 1), lambda x: ~x.isin(STANDARD_PREFIXES))
    spaces = F.filter(F.regexp_extract_all(t, F.lit(r"<([^>]+)#[^>]+>"), 1), lambda x: ~F.coalesce(*[F.when(x.contains(u), True) for u in STANDARD_URIS], F.lit(False)))
    names = texts.select(key, F.explode(F.concat(F.transform(prefixes, lambda x: F.struct(F.lit("prefix").alias("mode"), x.alias("target"))), F.transform(spaces, lambda x: F.struct(F.lit("uri").alias("mode"), x.alias("target"))))).alias("x"))
    counts = names.groupBy(key, "x.mode", "x.target").agg(F.count(F.lit(1)).alias("n")).where((F.col("mode") == "uri") | (F.col("n") > most))
    rank = F.struct((F.col("mode") == "uri").alias("u"), (F.col("target") != "ns1").alias("o"), (-F.col("n")).alias("n"), F.col("target"), F.col("mode"))
    best = counts.groupBy(key).agg(F.min(rank).alias("b")).select(F.col(key).alias("_key"), F.col("b.mode").alias("mode"), F.col("b.target").alias("target"))
    return texts.select(key).distinct().join(best, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("mode", F.lit("unknown")).alias("mode"), "target")


def declared(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, category) of terms declared in the text itself, named by prefix or in full."""
    kinds = F.create_map(*[F.lit(x) for x in ("Class", "class", "ObjectProperty", "object property", "DatatypeProperty", "data property", "AnnotationProperty", "data property", "NamedIndividual", "individual")])
    form = r"(?:<[^>]+#|\b\w+:)([^>\s]+?)>?\s+(?:rdf:type|a)\s+owl:(Class|ObjectProperty|DatatypeProperty|AnnotationProperty|NamedIndividual)\b"
    t = F.coalesce(F.col(text), F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(t, F.lit(form), 1).alias("term"), F.regexp_extract_all(t, F.lit(form), 2).alias("kind"))
    return texts.select(key, F.explode(both).alias("x")).select(key, F.col("x.term").alias("term"), F.element_at(kinds, F.col("x.kind")).alias("category")).distinct()


def category_by_name(term: Column) -> Column:
    """What a term without a declaration is, by the form of its name: an individual, a property or a class."""
    return F.when(term.rlike(INDIVIDUAL_NAMES), "individual").when(term.rlike(PROPERTY_NAMES), "object property").otherwise("class")


def terms(texts: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    """(term, category) of all terms with the prefix: as declared, else by name."""
    t = F.coalesce(F.col(text), F.lit(""))
    used = texts.select(F.explode(F.regexp_extract_all(t, F.lit(rf"\b{re.escape(prefix)}:([A-Za-z][A-Za-z0-9_]*)\b"), 1)).alias("term")).where(~F.lower("term").isin(_NOT_TERMS)).distinct()
    told = declared(texts, key, text).select("term", "category").distinct()
    free = used.join(told, "term", "left_anti").select("term", category_by_name(F.col("term")).alias("category"))
    return told.unionByName(free).distinct()


def rewrite_names(texts: DataFrame, mapping: DataFrame, key: str, text: str, prefix: str, target: str = "http://www.example.com/abstracted.owl#") -> DataFrame:
    """Replaces prefix:term and <...#term> of mapped terms by the abstract name in full; other text stays as it is.

    Texts are cut into names and what lies between; names are joined with the mapping, whose size is free. Every row gives one
    row; a null text gives an empty one; of a term's names the least is taken.
    """
    name = rf"<[^>\s]+#[^>]+>|\b{re.escape(prefix)}:[A-Za-z][A-Za-z0-9_]*"
    names = least_names(mapping)

    def new(distinct: DataFrame) -> DataFrame:
        marked = F.regexp_replace("text", f"({name})", "\u0001$1\u0001")
        bits = distinct.select("h", F.posexplode(F.split(marked, "\u0001")).alias("n", "w"))
        bits = bits.withColumn("term", F.when(F.col("w").rlike(f"^({name})$"), F.regexp_extract("w", r"[#:]([^#:>]+)>?$", 1)))
        bits = bits.join(names, "term", "left").select("h", "n", F.when(F.col("abstract").isNull(), F.col("w")).otherwise(F.concat(F.lit(f"<{target}"), "abstract", F.lit(">"))).alias("w"))
        return bits.groupBy("h").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]), "").alias("new"))

    return by_text(texts.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)), key, text, new)
