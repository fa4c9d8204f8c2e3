"""Turtle and RDF/XML readers, from text to entailed facts."""

from graphloom.operators import closure
from graphloom.sources import rdf

TTL = """@prefix : <http://x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
# a comment
:isSisterOf rdfs:subPropertyOf :isSiblingOf . :isSiblingOf a owl:SymmetricProperty .
:isUncleOf owl:propertyChainAxiom ( :isBrotherOf :isParentOf ) .
:Parent owl:equivalentClass [ a owl:Restriction ; owl:onProperty :isParentOf ; owl:someValuesFrom :Person ] .
:ada a :Person ; :isSisterOf :gwen , :zoe ; :born 1868 ; rdfs:label "Ada \\"A\\""@en .
:bob :isBrotherOf :cy . :cy :isParentOf :ada .
"""
XML = """<?xml version="1.0"?><rdf:RDF xmlns="http://x#" xml:base="http://x" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">
<owl:ObjectProperty rdf:about="#knows"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#SymmetricProperty"/></owl:ObjectProperty>
<owl:NamedIndividual rdf:about="#ada"><knows rdf:resource="#bob"/><age rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">3</age></owl:NamedIndividual>
<owl:Class rdf:about="#C"><owl:equivalentClass><owl:Class><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="#A"/><owl:Class rdf:about="#B"/></owl:unionOf></owl:Class></owl:equivalentClass></owl:Class></rdf:RDF>"""


def test_parse():
    rows = rdf.parse(TTL)
    assert ("http://x#ada", "http://x#born", "1868", "literal", rdf.XSD + "integer", None) in rows
    assert any(r[2] == 'Ada "A"' and r[5] == "en" for r in rows)
    assert ("http://x#ada", "http://x#knows", "http://x#bob", "iri", None, None) in rdf.parse(XML)


def test_directory(spark, tmp_path):
    (tmp_path / "one.ttl").write_text(TTL)
    (tmp_path / "two.owl").write_text(XML)
    (tmp_path / "bad.ttl").write_text(":x :y")
    (tmp_path / "no.txt").write_text("x")
    triples = rdf.read(spark, str(tmp_path)).cache()
    assert {r.graph_id for r in triples.select("graph_id").distinct().collect()} == {"one", "two", "bad"}
    assert triples.where("o_kind = 'error'").count() == 1
    t = rdf.terminology(triples)
    assert ("http://x#isBrotherOf", "http://x#isParentOf", "http://x#isUncleOf") in t.chains and ("http://x#C", ["http://x#A", "http://x#B"]) in t.unions
    facts, types = rdf.facts_and_types(triples)
    closed = closure.close_facts(facts, t)
    short = {tuple(x.replace("http://x#", "") for x in r) for r in closed.collect()}
    assert {("one", "gwen", "isSiblingOf", "ada"), ("one", "bob", "isUncleOf", "ada"), ("two", "bob", "knows", "ada")} <= short
    kinds = {tuple(x.replace("http://x#", "") for x in r) for r in closure.close_types(types, closed, t).collect()}
    assert ("one", "cy", "Parent") in kinds
