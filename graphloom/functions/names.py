"""Names, IRIs, keys, SPARQL strings and tags as Column expressions: all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
FAMILY = "http://www.example.com/genealogy.owl#"


def short_form(iri: Column) -> Column:
    """After the last '#', else after the last '/'; null gives 'null'."""
    tail = F.when(F.instr(iri, "#") > 0, F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))
    return F.coalesce(tail, F.lit("null"))


def extractor_name(iri: Column) -> Column:
    """After the first '#', else after the last '/'."""
    return F.when(F.instr(iri, "#") > 0, F.regexp_extract(iri, "^[^#]*#(.*)$", 1)).otherwise(F.substring_index(iri, "/", -1))


def local_name(iri: Column) -> Column:
    """After the last '#' or '/', whichever is later; the whole text where nothing follows; null gives ''."""
    tail = F.regexp_extract(iri, "([^#/]+)$", 1)
    return F.coalesce(F.when(tail != "", tail).otherwise(iri), F.lit(""))


def namespace(iri: Column) -> Column:
    """Up to and with the last '#' or '/'; the whole text without one (or with one at its start only)."""
    head = F.regexp_extract(iri, "^(.+[#/]|[#/].*[#/])[^#/]*$", 1)
    return F.coalesce(F.when(head != "", head).otherwise(iri), F.lit(""))


def full_uri(short: Column) -> Column:
    rest = lambda n: F.substring(short, n + 1, 1 << 30)
    return (
        F.when(short == "", short)
        .when(short.startswith("rdfs:"), F.concat(F.lit(RDFS), rest(5)))
        .when(short.startswith("owl:"), F.concat(F.lit(OWL), rest(4)))
        .when(short.startswith("rdf:"), F.concat(F.lit(RDF), rest(4)))
        .otherwise(F.concat(F.lit(FAMILY), short))
    )


def triple_key(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws("|", s, p, o)


def ask(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("ASK WHERE { <"), full_uri(s), F.lit("> <"), full_uri(p), F.lit("> <"), full_uri(o), F.lit("> }"))


def select(s: Column, p: Column) -> Column:
    return F.concat(F.lit("SELECT ?x WHERE { <"), full_uri(s), F.lit("> <"), full_uri(p), F.lit("> ?x }"))


def task_id(root: Column, s: Column, p: Column, kind: str) -> Column:
    """Carries the literal '1hop' whatever the hop count, as published task ids do."""
    part = lambda c, d: F.coalesce(c, F.lit(d))
    return F.concat(F.lit("1hop-"), part(root, "Thing"), F.lit("_"), part(s, "unknown"), F.lit("-"), part(s, "unknown"), F.lit("-"), part(p, "unknown"), F.lit(f"-{kind}"))


def task_type(p: Column) -> Column:
    return F.when(p == "rdf:type", "Membership").otherwise("Property Assertion")


def pattern_query(kind: str, s: Column, p: Column, o: Column) -> Column:
    """A SPARQL text over a triple pattern; null parts become variables, rdf:type becomes 'a', plain objects are quoted."""
    iri = lambda c: F.when(c.startswith("http"), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(c)
    subject = F.coalesce(iri(s), F.lit("?s"))
    predicate = F.coalesce(F.when((p == "rdf:type") | (p == RDF + "type"), F.lit("a")).otherwise(iri(p)), F.lit("?p"))
    value = F.coalesce(F.when(o.startswith("http"), iri(o)).otherwise(F.concat(F.lit('"'), o, F.lit('"'))), F.lit("?o"))
    head = "ASK WHERE { " if kind == "ASK" else "SELECT * WHERE { "
    return F.concat(F.lit(head), F.concat_ws(" ", subject, predicate, value), F.lit(" }"))


# ---- tags -----------------------------------------------------------------------------------------------------------
#: Letters of axiom kinds (fixed values).
AXIOM_TAGS = {
    "ClassAssertion": "D", "ObjectPropertyAssertion": "D", "DataPropertyAssertion": "D",
    "SubClassOf": "H", "SubObjectPropertyOf": "H", "SubDataPropertyOf": "H",
    "EquivalentClasses": "Q", "EquivalentObjectProperties": "Q", "EquivalentDataProperties": "Q",
    "DisjointClasses": "J", "DisjointObjectProperties": "J", "DisjointDataProperties": "J",
    "TransitiveObjectProperty": "T", "SymmetricObjectProperty": "S", "AsymmetricObjectProperty": "A",
    "ReflexiveObjectProperty": "V", "IrreflexiveObjectProperty": "Y", "InverseObjectProperties": "I",
    "FunctionalObjectProperty": "F", "FunctionalDataProperty": "F", "InverseFunctionalObjectProperty": "F",
    "ObjectPropertyDomain": "R", "ObjectPropertyRange": "R", "DataPropertyDomain": "R", "DataPropertyRange": "R",
    "SubPropertyChainOf": "N",
}
#: Order of letters in a tag (fixed value).
TAG_ORDER = "DHQTSIFNELC∩URMJVAY¬"
#: Words of justification texts, tried in this order: (letter, words) (fixed values).
TEXT_TAGS = [
    ("H", ["subclassof", "subpropertyof", "⊑"]), ("Q", ["equivalentclass", "equivalentproperty", "≡"]),
    ("R", ["domain(", "range(", "rdfs:domain", "rdfs:range"]), ("T", ["transitive"]), ("S", ["symmetric"]),
    ("V", ["reflexive"]), ("I", ["inverse", "⁻"]), ("F", ["functional"]), ("J", ["disjoint"]), ("N", ["propertychain", "∘", "○"]),
    ("E", ["somevaluesfrom", "∃"]), ("L", ["allvaluesfrom", "∀"]), ("C", ["cardinality", "min ", "max ", "exactly "]),
    ("∩", ["intersection", "∩", "member of all"]), ("U", ["union", "∪"]), ("¬", ["complement", "¬"]),
]
#: Kinds counted for multi-step, for axioms and for texts (fixed values).
TEXT_KINDS = [
    ("HIERARCHY", ["subclassof", "subpropertyof"]), ("EQUIVALENCE", ["equivalentclass", "equivalentproperty"]), ("DOMAIN_RANGE", ["domain", "range"]),
    ("TRANSITIVITY", ["transitive"]), ("SYMMETRY", ["symmetric"]), ("INVERSE", ["inverse"]), ("FUNCTIONAL", ["functional"]), ("PROPERTY_CHAIN", ["propertychain"]),
    ("DISJOINT", ["disjoint"]), ("INTERSECTION", ["intersection"]), ("UNION", ["union"]), ("EXISTENTIAL", ["somevaluesfrom"]), ("UNIVERSAL", ["allvaluesfrom"]), ("CARDINALITY", ["cardinality"]),
]
_TBOX_WORDS = ["subclassof", "subpropertyof", "equivalentclass", "equivalentproperty", "disjoint", "domain", "range", "transitive", "symmetric", "functional", "inverse", "propertychain", "somevaluesfrom", "allvaluesfrom", "cardinality", "intersectionof", "unionof", "complementof"]
_COMPLEX = [("∩", "intersectionof"), ("U", "unionof"), ("¬", "complementof"), ("E", "somevaluesfrom"), ("L", "allvaluesfrom"), ("C", "cardinality")]
_KIND_OF_TAG = {"H": "HIERARCHY", "Q": "EQUIVALENCE", "R": "DOMAIN_RANGE", "T": "TRANSITIVITY", "S": "SYMMETRY", "I": "INVERSE", "F": "FUNCTIONAL", "N": "PROPERTY_CHAIN", "J": "DISJOINT", "A": "OTHER", "V": "OTHER", "Y": "OTHER"}


def _any(text: Column, words: list[str]) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def _first(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    out = F
    for value, words in rules:
        out = out.when(_any(text, words), F.lit(value))
    return out.otherwise(F.lit(default))


def axiom_tag(kind: Column, text: Column) -> Column:
    """Letter of an axiom from its kind, else from the class constructors its text names."""
    out = F
    for letter in dict.fromkeys(AXIOM_TAGS.values()):
        out = out.when(kind.isin([k for k, v in AXIOM_TAGS.items() if v == letter]), F.lit(letter))
    lower = F.lower(text)
    for letter, word in _COMPLEX:
        out = out.when(lower.contains(word), F.lit(letter))
    return out.otherwise(F.lit(""))


def text_tag(text: Column) -> Column:
    """Letter of a justification text: first matching rule; '' if none or empty."""
    lower = F.lower(F.trim(text))
    direct = (lower.contains("rdf:type") | lower.contains("a ")) & ~_any(lower, ["subclassof", "subpropertyof", "domain", "range"])
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit("")).when(direct, F.lit("D")).otherwise(_first(lower, TEXT_TAGS, ""))


def text_kind(text: Column) -> Column:
    return _first(F.lower(F.trim(text)), TEXT_KINDS, "OTHER")


def is_tbox_text(text: Column) -> Column:
    return _any(F.lower(text), _TBOX_WORDS)


def axiom_kind(letter: Column) -> Column:
    out = F
    for k, v in _KIND_OF_TAG.items():
        out = out.when(letter == k, F.lit(v))
    return out.otherwise(F.lit(None).cast("string"))


def redundant(text: Column, axioms: Column) -> Column:
    """Whether a justification repeats an axiom already counted: axioms is the array of lower-case axiom texts."""
    lower = F.lower(F.trim(text))
    has = lambda w: F.exists(axioms, lambda a: a.contains(w))
    return (lower.contains("rdf:type") & has("classassertion")) | (lower.contains("rdfs:subclassof") & has("subclassof")) | (lower.contains("domain(") & has("domain")) | (lower.contains("range(") & has("range"))


def ordered_tag(letters: Column) -> Column:
    """Letters of an array in the fixed order, repeated by count; null for none."""
    placed = F.transform(letters, lambda x: F.concat(_place(x), x))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: F.substring(x, 2, 4)), "")


def _place(letter: Column) -> Column:
    """A sort key of one character: the letter's place in the order."""
    return F.translate(letter, TAG_ORDER, "abcdefghijklmnopqrstuvwxyz"[: len(TAG_ORDER)])


def with_tag(paths: DataFrame) -> DataFrame:
    """paths(axioms array<struct<kind, text>>, justifications array<string>) with its `tag`.

    Every distinct axiom gives its letter, every distinct justification that repeats none of them its own; 'M' joins if
    two or more kinds of terminological statements take part, or if nothing else does. Worked out in steps of one
    projection each, so that no expression is evaluated twice.
    """
    df = paths.withColumn("_a", F.array_distinct("axioms"))
    df = df.withColumn("_at", F.transform("_a", lambda a: F.lower(F.concat(a["kind"], F.lit("("), a["text"])))).withColumn("_al", F.transform("_a", lambda a: axiom_tag(a["kind"], a["text"])))
    df = df.withColumn("_ak", F.transform("_a", lambda a: axiom_kind(axiom_tag(a["kind"], F.lit("")))))
    df = df.withColumn("_j", F.filter(F.array_distinct("justifications"), lambda j: ~redundant(j, F.col("_at"))))
    df = df.withColumn("_jl", F.transform("_j", text_tag)).withColumn("_jk", F.transform("_j", lambda j: F.when(is_tbox_text(j), text_kind(j))))
    df = df.withColumn("_n", F.size(F.array_distinct(F.array_compact(F.concat("_ak", "_jk")))))
    letters = F.filter(F.concat("_al", "_jl", F.when(F.col("_n") >= 2, F.array(F.lit("M"))).otherwise(F.array().cast("array<string>"))), lambda x: x != "")
    df = df.withColumn("_tag", ordered_tag(letters))
    return df.withColumn("tag", F.when(F.col("_tag") == "", "M").otherwise(F.col("_tag"))).drop("_a", "_at", "_al", "_ak", "_j", "_jl", "_jk", "_n", "_tag")
