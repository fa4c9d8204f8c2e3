"""Plain-English descriptions of classes, properties and restrictions from RDF triples (s, p, o) with short predicate names.

Everything is a projection of the triples that is grouped by subject; lists are sorted by name, so texts don't depend on
row order. Defined cases: an empty table gives no rows; repeated triples count once; triples with a null are left out.
The sentences are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verbal import clean_name, listed

#: Predicates whose values are labels, best first (fixed values).
LABELS = ["rdfs:label", "skos:prefLabel", "dc:title", "foaf:name", "schema:name"]
#: What each characteristic of a property means (fixed values).
CHARACTERISTICS = {
    "owl:FunctionalProperty": "This property is functional (each entity can have at most one value).",
    "owl:InverseFunctionalProperty": "This property is inverse functional (each value can be related to at most one entity).",
    "owl:SymmetricProperty": "This property is symmetric (if A relates to B, then B relates to A).",
    "owl:AsymmetricProperty": "This property is asymmetric (if A relates to B, then B cannot relate to A).",
    "owl:TransitiveProperty": "This property is transitive (it can form chains of relationships).",
    "owl:IrreflexiveProperty": "This property is irreflexive (an entity cannot have this relationship with itself).",
}


def _once(triples: DataFrame) -> DataFrame:
    return triples.select("s", "p", "o").dropna().distinct()


def entities(triples: DataFrame) -> DataFrame:
    """(node, kind): classes, object and data properties by their declared type."""
    kind = F.when(F.col("o") == "owl:Class", "class").when(F.col("o") == "owl:ObjectProperty", "object property").when(F.col("o") == "owl:DatatypeProperty", "data property")
    return _once(triples).where("p = 'rdf:type'").select(F.col("s").alias("node"), kind.alias("kind")).where("kind is not null").distinct()


def individuals(triples: DataFrame) -> DataFrame:
    """(node): declared individuals, instances of known classes, and ends of triples of object properties, without what is
    typed as schema."""
    t = _once(triples)
    known = entities(t)
    schema = known.select("node")
    types = t.where("p = 'rdf:type'")
    declared = types.where("o = 'owl:NamedIndividual'").select(F.col("s").alias("node"))
    classes = known.where("kind = 'class'").select(F.col("node").alias("o"))
    instances = types.join(classes, "o", "left_semi").select(F.col("s").alias("node"))
    properties = known.where("kind = 'object property'").select(F.col("node").alias("p"))
    edges = t.join(properties, "p", "left_semi")
    ends = edges.select(F.col("s").alias("node")).union(edges.select(F.col("o").alias("node")))
    return declared.union(instances).union(ends).distinct().join(schema, "node", "left_anti")


def labels(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the smallest value of the best label predicate, else the local name, cleaned."""
    rank = F.array_position(F.array(*map(F.lit, LABELS)), F.col("p"))
    best = _once(triples).where(F.col("p").isin(LABELS)).groupBy(F.col("s").alias("node")).agg(F.min(F.struct(rank.alias("r"), "o"))["o"].alias("told"))
    return nodes.select("node").distinct().join(best, "node", "left").select("node", clean_name(F.coalesce("told", F.regexp_extract("node", r"([^#/]*)$", 1))).alias("label"))


def restriction_text(kind: Column, prop: Column, filler: Column, n: Column) -> Column:
    """What an anonymous class of one restriction asks for; null for other kinds."""
    return (
        F.when(kind == "some", F.concat(F.lit("that has some '"), prop, F.lit("' relationship with an instance of "), filler))
        .when(kind == "only", F.concat(F.lit("that only has '"), prop, F.lit("' relationships with instances of "), filler))
        .when(kind == "exactly", F.concat(F.lit("that has exactly "), n.cast("string"), F.lit(" '"), prop, F.lit("' relationship(s) with an instance of "), filler))
    )


def _gathered(triples: DataFrame, names: DataFrame, predicate: str, out: str, by: str = "s", of: str = "o") -> DataFrame:
    t = triples.where(F.col("p") == predicate).select(F.col(by).alias("node"), F.col(of).alias("other"))
    return t.join(names.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.sort_array(F.collect_set("label")).alias(out))


def class_text(triples: DataFrame) -> DataFrame:
    """(node, text): parents, equivalents, disjoint classes, up to three properties with this domain; else a plain sentence."""
    t = _once(triples)
    nodes = entities(t)
    names = labels(t, nodes)
    c = names.join(nodes.where("kind = 'class'").select("node"), "node", "left_semi")
    for predicate, out, by, of in (("rdfs:subClassOf", "ups", "s", "o"), ("owl:equivalentClass", "same", "s", "o"), ("owl:disjointWith", "apart", "s", "o"), ("rdfs:domain", "having", "o", "s")):
        c = c.join(_gathered(t, names, predicate, out, by, of), "node", "left")
    n = F.col("label")
    parts = F.array(
        F.when(F.size("ups") > 0, F.concat(n, F.lit(" is a type of "), listed(F.col("ups")), F.lit("."))),
        F.when(F.size("same") > 0, F.concat(n, F.lit(" is equivalent to "), listed(F.col("same")), F.lit("."))),
        F.when(F.size("apart") > 0, F.concat(n, F.lit(" is disjoint with "), F.array_join("apart", " and "), F.lit("."))),
        F.when(F.size("having").between(1, 3), F.concat(F.lit("Instances of "), n, F.lit(" can have "), F.regexp_replace(F.array_join("having", ", "), ", ([^,]*)$", " and $1"), F.lit(" relationships."))),
    )
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull()), " ")
    return c.select("node", F.when(text == "", F.concat(n, F.lit(" is a class in this ontology."))).otherwise(text).alias("text"))


def property_text(triples: DataFrame) -> DataFrame:
    """(node, text): super-properties, characteristics, inverse, equivalent and disjoint ones, domain and range."""
    t = _once(triples)
    nodes = entities(t)
    names = labels(t, nodes)
    c = names.join(nodes.where("kind = 'object property'").select("node"), "node", "left_semi")
    for predicate, out in (("rdfs:subPropertyOf", "ups"), ("owl:inverseOf", "inverse"), ("owl:equivalentProperty", "same"), ("owl:propertyDisjointWith", "apart"), ("rdfs:domain", "domains"), ("rdfs:range", "ranges")):
        c = c.join(_gathered(t, names, predicate, out), "node", "left")
    traits = t.where("p = 'rdf:type'").groupBy(F.col("s").alias("node")).agg(F.collect_set("o").alias("traits"))
    c = c.join(traits, "node", "left")
    parts = F.array(
        F.concat("label", F.lit(" is a relationship property.")),
        F.when(F.size("ups") > 0, F.concat(F.lit("It is a sub-property of "), F.array_join("ups", " and "), F.lit("."))),
        *(F.when(F.array_contains("traits", k), F.lit(v)) for k, v in CHARACTERISTICS.items()),
        F.when(F.size("inverse") > 0, F.concat(F.lit("It is the inverse of the "), F.array_join("inverse", " and "), F.lit(" property."))),
        F.when(F.size("same") > 0, F.concat(F.lit("This property is equivalent to "), F.array_join("same", " and "), F.lit("."))),
        F.when(F.size("apart") > 0, F.concat(F.lit("This property is disjoint with "), F.array_join("apart", " and "), F.lit("."))),
        F.when((F.size("domains") > 0) & (F.size("ranges") > 0), F.concat(F.lit("This property connects "), F.array_join("domains", " or "), F.lit(" to "), F.array_join("ranges", " or "), F.lit("."))),
    )
    return c.select("node", F.array_join(F.filter(parts, lambda x: x.isNotNull()), " ").alias("text"))


def document(classes: DataFrame, properties: DataFrame, people: DataFrame) -> DataFrame:
    """(part, place, node, text): the ontology's description, its parts in order and each part's entries by name. Rows, not
    one value: an ontology may have any number of entries. Entries are placed by their names, which are their keys."""
    part = lambda df, k: df.select(F.lit(k).alias("part"), "node", "text")
    return part(classes, "1 classes").unionByName(part(properties, "2 object properties")).unionByName(part(people, "3 individuals"))
