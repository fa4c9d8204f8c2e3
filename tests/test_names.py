"""Name helpers and tags against hand-worked values."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import names


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("iri, short, first, local", [
    ("http://a/b#c", "c", "c", "c"), ("http://a/b", "b", "b", "b"), ("http://a#b#c", "c", "b#c", "c"), ("http://a/b#", "", "", "http://a/b#"), ("plain", "plain", "plain", "plain"),
])
def test_shorteners(spark, iri, short, first, local):
    c = F.lit(iri)
    assert one(spark, names.short_form(c)) == short
    assert one(spark, names.extractor_name(c)) == first
    assert one(spark, names.local_name(c)) == local


def test_full_uri(spark):
    assert one(spark, names.full_uri(F.lit("rdf:type"))) == names.RDF + "type"
    assert one(spark, names.full_uri(F.lit("ada"))) == names.FAMILY + "ada"
    assert one(spark, names.task_id(F.lit("r"), F.lit("s"), F.lit("p"), "MC")) == "1hop-r_s-s-p-MC"


@pytest.mark.parametrize("text, tag", [("i rdf:type C", "D"), ("C SubClassOf D", "H"), ("IrreflexiveObjectProperty(p)", "V"), ("AsymmetricObjectProperty(p)", "S"), ("ada knows bob", "D"), ("", ""), ("bob knows cy", "")])
def test_text_tag(spark, text, tag):
    assert one(spark, names.text_tag(F.lit(text))) == tag


def tag(spark, axioms, texts):
    df = spark.createDataFrame([(axioms, texts)], "axioms array<struct<kind:string,text:string>>, justifications array<string>")
    return names.with_tag(df).first().tag


def test_path_tags(spark):
    a = ("ObjectPropertyAssertion", "s p o")
    assert tag(spark, [a], ["s p o"]) == "D"
    assert tag(spark, [a, ("SubObjectPropertyOf", "p rdfs:subPropertyOf q")], ["s p o", "p rdfs:subPropertyOf q"]) == "DHH"
    assert tag(spark, [a, ("ObjectPropertyDomain", "domain(p) = C")], ["s p o", "domain(p) = C"]) == "DR"
    assert tag(spark, [a, ("InverseObjectProperties", "p owl:inverseOf q"), ("ObjectPropertyDomain", "domain(p) = C")], ["s q o", "p owl:inverseOf q", "domain(p) = C"]) == "DIIRM"
    assert tag(spark, [("ClassAssertion", "i rdf:type X"), ("SubClassOf", "X rdfs:subClassOf C")], ["i rdf:type X", "X rdfs:subClassOf C"]) == "DH"
    assert tag(spark, [], []) == "M"
