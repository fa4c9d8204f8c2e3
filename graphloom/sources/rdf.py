"""Turtle and RDF/XML files as a triples table: one task a file, read as a stream of statements.

triples(graph_id, s, p, o, o_kind, o_dtype, o_lang); blank nodes are '_:<file>.b<n>'. Covers Turtle's
prefixes, base, 'a', ';' and ',' lists, blank node property lists, collections and literals; and RDF/XML's typed nodes,
about/ID/nodeID/resource, parseType Resource/Collection/Literal, datatype, xml:lang and property attributes. A file that
cannot be read gives one row of kind 'error' with the message, so one bad file doesn't fail a directory.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import RDF

SCHEMA = "graph_id string, s string, p string, o string, o_kind string, o_dtype string, o_lang string"
XSD = "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dtype>\^\^)|(?P<blank>_:[\w.\-]*[\w\-])|(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w:]))|(?P<name>[\w\-.]*:[\w\-.%:]*[\w\-%]|[\w\-.]*:)|(?P<word>[A-Za-z]+)|(?P<sign>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


def _plain(text: str) -> str:
    table = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else table.get(m[1], m[1]), text)


class Turtle:
    def __init__(self, text: str):
        self.tokens = self._scan(text)
        self.prefixes: dict[str, str] = {}
        self.base, self.count = "", 0
        self.out: list[tuple] = []
        self.next()

    @staticmethod
    def _scan(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unreadable at {at}: {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0]
        yield "end", ""

    def next(self) -> tuple[str, str]:
        seen = getattr(self, "now", None)
        self.now = next(self.tokens, ("end", ""))
        return seen

    def sign(self, s: str) -> bool:
        if self.now == ("sign", s):
            self.next()
            return True
        return False

    def fresh(self) -> str:
        self.count += 1
        return f"_:b{self.count}"

    def iri(self, kind: str, value: str) -> str:
        if kind == "iri":
            return value[1:-1] if ":" in value else self.base + value[1:-1]
        prefix, _, local = value.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + local

    def run(self) -> list[tuple]:
        while self.now[0] != "end":
            kind, value = self.now
            if value.lower() in ("@prefix", "prefix"):
                self.next()
                name = self.next()[1]
                self.prefixes[name.rstrip(":")] = self.iri(*self.next())
                self.sign(".")
            elif value.lower() in ("@base", "base"):
                self.next()
                self.base = self.next()[1][1:-1]
                self.sign(".")
            else:
                bare = kind == "sign" and value == "["
                s = self.node()[0]
                if not (bare and self.now == ("sign", ".")):
                    self.properties(s)
                if not self.sign("."):
                    raise ValueError(f"'.' expected, found {self.now[1]!r}")
        return self.out

    def properties(self, s: str) -> None:
        while True:
            kind, value = self.next()
            p = RDF + "type" if (kind, value) == ("word", "a") else self.iri(kind, value)
            while True:
                self.out.append((s, p, *self.node()))
                if not self.sign(","):
                    break
            again = False
            while self.sign(";"):
                again = True
            if not again or self.now[1] in (".", "]"):
                return

    def node(self) -> tuple[str, str, str | None, str | None]:
        kind, value = self.next()
        if kind in ("iri", "name"):
            return self.iri(kind, value), "iri", None, None
        if kind == "blank":
            return value, "blank", None, None
        if (kind, value) == ("sign", "["):
            b = self.fresh()
            if not self.sign("]"):
                self.properties(b)
                if not self.sign("]"):
                    raise ValueError("']' expected")
            return b, "blank", None, None
        if (kind, value) == ("sign", "("):
            items = []
            while not self.sign(")"):
                items.append(self.node())
            return self.collection(items)
        if kind in ("text", "long"):
            body = _plain(value[3:-3] if kind == "long" else value[1:-1])
            if self.now[0] == "lang":
                return body, "literal", None, self.next()[1][1:]
            if self.now[0] == "dtype":
                self.next()
                return body, "literal", self.iri(*self.next()), None
            return body, "literal", XSD + "string", None
        if kind == "number":
            return value, "literal", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if value in ("true", "false"):
            return value, "literal", XSD + "boolean", None
        raise ValueError(f"unexpected {value!r}")

    def collection(self, items: list) -> tuple:
        head = (RDF + "nil", "iri", None, None)
        for x in reversed(items):
            b = self.fresh()
            self.out.append((b, RDF + "first", *x))
            self.out.append((b, RDF + "rest", *head))
            head = (b, "blank", None, None)
        return head


class RdfXml:
    XML = "{http://www.w3.org/XML/1998/namespace}"
    R = "{" + RDF + "}"

    def __init__(self, text: str):
        self.root = ET.fromstring(text.encode())
        self.base = self.root.get(self.XML + "base", "")
        self.count, self.out = 0, []

    def fresh(self) -> str:
        self.count += 1
        return f"_:b{self.count}"

    def iri(self, value: str) -> str:
        return value if ":" in value else self.base + value

    @staticmethod
    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def run(self) -> list[tuple]:
        for e in self.root if self.root.tag == self.R + "RDF" else [self.root]:
            self.node(e)
        return self.out

    def node(self, e) -> tuple[str, str]:
        if (v := e.get(self.R + "about")) is not None:
            s, kind = self.iri(v), "iri"
        elif (v := e.get(self.R + "ID")) is not None:
            s, kind = self.iri("#" + v), "iri"
        else:
            s, kind = ("_:n" + e.get(self.R + "nodeID") if e.get(self.R + "nodeID") else self.fresh()), "blank"
        if e.tag != self.R + "Description":
            self.out.append((s, RDF + "type", self.name(e.tag), "iri", None, None))
        for k, v in e.attrib.items():
            if not k.startswith((self.R, self.XML)):
                self.out.append((s, self.name(k), v, "literal", XSD + "string", None))
        for p in e:
            self.prop(s, p)
        return s, kind

    def prop(self, s: str, p) -> None:
        q, kind = self.name(p.tag), p.get(self.R + "parseType")
        if (v := p.get(self.R + "resource")) is not None:
            self.out.append((s, q, self.iri(v), "iri", None, None))
        elif (v := p.get(self.R + "nodeID")) is not None:
            self.out.append((s, q, "_:n" + v, "blank", None, None))
        elif kind == "Resource":
            b = self.fresh()
            self.out.append((s, q, b, "blank", None, None))
            for x in p:
                self.prop(b, x)
        elif kind == "Collection":
            head = (RDF + "nil", "iri")
            for x in reversed([self.node(c) for c in p]):
                b = self.fresh()
                self.out += [(b, RDF + "first", *x, None, None), (b, RDF + "rest", *head, None, None)]
                head = (b, "blank")
            self.out.append((s, q, *head, None, None))
        elif kind == "Literal":
            self.out.append((s, q, (p.text or "") + "".join(ET.tostring(c, "unicode") for c in p), "literal", RDF + "XMLLiteral", None))
        elif len(p):
            self.out.append((s, q, *self.node(p[0]), None, None))
        else:
            lang = p.get(self.XML + "lang")
            self.out.append((s, q, p.text or "", "literal", None if lang else p.get(self.R + "datatype", XSD + "string"), lang))


def parse(text: str) -> list[tuple]:
    """(s, p, o, o_kind, o_dtype, o_lang) of a Turtle or RDF/XML text, told by its first sign."""
    head = text.lstrip("﻿ \t\r\n")
    return RdfXml(head).run() if head.startswith(("<?xml", "<rdf:RDF", "<!DOCTYPE", "<!--")) else Turtle(text).run()


def read(spark: SparkSession, path: str, pattern: str = "*.{[oO][wW][lL],[tT][tT][lL],[rR][dD][fF],[nN]3}") -> DataFrame:
    """The triples of every file under path, in tasks of their own; graph_id is the file's name without its extension."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    files = files.repartition(F.col("path"))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                graph = re.sub(r"\.(owl|ttl|rdf|n3)$", "", path.rsplit("/", 1)[-1])
                try:
                    own = lambda v, g=graph: f"_:{g}.{v[2:]}" if v.startswith("_:") else v
                    rows += [(graph, own(t[0]), t[1], own(t[2]) if t[3] == "blank" else t[2], *t[3:]) for t in parse(bytes(content).decode("utf-8", "replace"))]
                except (ValueError, ET.ParseError, StopIteration, RecursionError) as e:
                    rows.append((graph, None, None, str(e), "error", None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)


class _Expressions:
    """Class expressions and lists out of schema statements: (s, p, o) of the terminology, as many as `most`."""

    def __init__(self, rows):
        from ..functions.names import OWL

        self.owl, self.by, self.one = OWL, {}, {}
        for s, p, o in rows:
            self.by.setdefault(p, []).append((s, o))
            self.one[s, p] = o

    def get(self, s, word: str):
        return self.one.get((s, self.owl + word))

    def items(self, head) -> list:
        out, seen = [], set()
        while head and head != RDF + "nil":
            if head in seen or (head, RDF + "first") not in self.one:
                raise ValueError("a list without an end")
            seen.add(head)
            out.append(self.one[head, RDF + "first"])
            head = self.one.get((head, RDF + "rest"))
        return out

    def prop(self, p):
        if named(p):
            return p
        if named(q := self.get(p, "inverseOf")):
            return ("inverse", q)
        raise ValueError("a property without a name")

    def read(self, x, depth: int = 0):
        """The expression of a node, named or blank, however deep; ValueError where there is none that is known."""
        if depth > 200:
            raise ValueError("an expression within itself, or over 200 deep")
        if named(x):
            return x
        deeper = lambda y: self.read(y, depth + 1)
        for word, kind in (("intersectionOf", "and"), ("unionOf", "or")):
            if head := self.get(x, word):
                return (kind, *map(deeper, self.items(head)))
        if y := self.get(x, "complementOf"):
            return ("not", deeper(y))
        if head := self.get(x, "oneOf"):
            return ("one", *self.items(head))
        if on := self.get(x, "onProperty"):
            p = self.prop(on)
            for word, kind in (("someValuesFrom", "some"), ("allValuesFrom", "only")):
                if y := self.get(x, word):
                    return (kind, p, deeper(y))
            if (v := self.get(x, "hasValue")) is not None:
                return ("value", p, v)
            if self.get(x, "hasSelf"):
                return ("self", p)
            for words, kind in ((("minCardinality", "minQualifiedCardinality"), "min"), (("maxCardinality", "maxQualifiedCardinality"), "max"), (("cardinality", "qualifiedCardinality"), "exact")):
                for word in words:
                    if n := self.get(x, word):
                        if self.get(x, "onDataRange"):
                            raise ValueError("a data range")
                        on_class = self.get(x, "onClass")
                        return (kind, int(n), p, deeper(on_class) if on_class else self.owl + "Thing")
        raise ValueError("an unknown kind of expression")


def named(x) -> bool:
    return x is not None and not x.startswith("_:")


#: Statements that make a terminology (names of the published vocabulary).
_RDFS = ("subClassOf", "subPropertyOf", "domain", "range")
_OWL = (
    "equivalentClass", "equivalentProperty", "inverseOf", "propertyChainAxiom", "disjointWith", "intersectionOf", "unionOf", "onProperty", "someValuesFrom", "allValuesFrom",
    "hasValue", "hasSelf", "minCardinality", "maxCardinality", "cardinality", "minQualifiedCardinality", "maxQualifiedCardinality", "qualifiedCardinality", "onClass", "complementOf", "oneOf",
    "disjointUnionOf", "propertyDisjointWith", "members", "hasKey", "onDataRange", "onDatatype",
)
_KINDS = ("TransitiveProperty", "SymmetricProperty", "FunctionalProperty", "InverseFunctionalProperty", "AsymmetricProperty", "IrreflexiveProperty", "ReflexiveProperty", "AllDisjointClasses", "AllDisjointProperties", "NegativePropertyAssertion")


def terminology(triples: DataFrame, most: int = 200_000, strict: bool = True):
    """The terminology of a triples table: schema statements only come to the driver, and no more than `most`.

    Class expressions may nest; simple ones fill the plain lists, all others `expressions` (see `reasoner.closure`). What is
    not understood (keys, reflexive properties, negative assertions, data ranges, broken lists) raises NotUnderstood with all
    such statements, or is listed in `left_out` if strict is False.
    """
    from ..functions.names import OWL, RDFS
    from ..operators.closure import Terminology
    from ..operators.rules import NotUnderstood

    kinds, schema = [OWL + k for k in _KINDS], [RDFS + k for k in _RDFS] + [OWL + k for k in _OWL] + [RDF + "first", RDF + "rest"]
    rows = triples.where(F.col("p").isin(schema) | ((F.col("p") == RDF + "type") & F.col("o").isin(kinds))).select("s", "p", "o").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"terminology of over {most} statements")
    x = _Expressions(sorted(tuple(r) for r in rows))
    said = lambda word, space=OWL: x.by.get(space + word, [])
    typed = lambda k: [s for s, o in x.by.get(RDF + "type", []) if o == OWL + k]
    t, left_out = Terminology(), []

    def each(rows, what: str, add) -> None:
        for s, o in rows:
            try:
                add(s, o)
            except ValueError as e:
                left_out.append((f"{s} {what} {o}", str(e)))

    def pair(into):
        def add(s, o):
            if not (named(s) and named(o)):
                raise ValueError("a part without a name")
            into.append((s, o))

        return add

    def simple(e) -> bool:
        return isinstance(e, tuple) and e[0] in ("some", "only") and isinstance(e[1], str) and isinstance(e[2], str)

    def sub_class(c, d) -> None:
        a, b = x.read(c), x.read(d)
        if isinstance(a, str) and isinstance(b, str):
            t.sub_class.append((a, b))
        elif isinstance(a, str) and simple(b):
            (t.exists if b[0] == "some" else t.only).append((a, b[1], b[2]))
        else:
            t.expressions.append((a, b))

    def equal(a, b) -> None:
        operand = lambda y: y if isinstance(y, str) else y[1:] if y[0] == "some" and simple(y) else None
        if not isinstance(a, str):
            a, b = b, a
        if isinstance(a, str) and isinstance(b, str):
            t.equivalent_class.append((a, b))
        elif isinstance(a, str) and simple(b) and b[0] == "some":
            t.exists.append((a, b[1], b[2]))
            t.some.append((b[1], b[2], a))
        elif isinstance(a, str) and b[0] == "and" and all(operand(y) for y in b[1:]):
            t.intersections.append((a, [operand(y) for y in b[1:]]))
        elif isinstance(a, str) and b[0] == "or" and all(isinstance(y, str) for y in b[1:]):
            t.unions.append((a, list(b[1:])))
        else:
            t.expressions += [(a, b), (b, a)]

    def chain(q, head) -> None:
        steps = [x.prop(p) for p in x.items(head)]
        if not named(q) or not steps:
            raise ValueError("a chain without steps, or for a property without a name")
        for p in (p for p in steps if isinstance(p, tuple)):
            t.inverse.append((f"inverse({p[1]})", p[1]))
        t.chains.append((*(p if isinstance(p, str) else f"inverse({p[1]})" for p in steps), q))

    def disjoint(a, b) -> None:
        a, b = x.read(a), x.read(b)
        if isinstance(a, str) and isinstance(b, str):
            t.disjoint.append((a, b))
        else:
            t.expressions.append((a, ("not", b)))

    def apart(parts, add) -> None:
        for k, a in enumerate(parts):
            for b in parts[k + 1 :]:
                add(a, b)

    def disjoint_union(c, head) -> None:
        parts = x.items(head)
        equal(x.read(c), ("or", *map(x.read, parts)))
        apart(parts, disjoint)

    def unknown(s, o):
        raise ValueError("no rule for it")

    each(said("subPropertyOf", RDFS), "rdfs:subPropertyOf", pair(t.sub_property))
    each(said("equivalentProperty"), "owl:equivalentProperty", pair(t.equivalent_property))
    each([(s, o) for s, o in said("inverseOf") if named(s)], "owl:inverseOf", pair(t.inverse))  # blank: an expression's part
    each(said("range", RDFS), "rdfs:range", lambda p, c: t.range.append((p, c)) if named(c) else t.expressions.append((OWL + "Thing", ("only", x.prop(p), x.read(c)))))
    each(said("domain", RDFS), "rdfs:domain", lambda p, c: t.domain.append((p, c)) if named(c) else t.expressions.append((("some", x.prop(p), OWL + "Thing"), x.read(c))))
    each(said("subClassOf", RDFS), "rdfs:subClassOf", sub_class)
    each(said("equivalentClass"), "owl:equivalentClass", lambda a, b: equal(x.read(a), x.read(b)))
    for word in ("intersectionOf", "unionOf", "complementOf", "oneOf"):
        kind = {"intersectionOf": "and", "unionOf": "or", "complementOf": "not", "oneOf": "one"}[word]
        read = lambda o, kind=kind: ("not", x.read(o)) if kind == "not" else ("one", *x.items(o)) if kind == "one" else (kind, *map(x.read, x.items(o)))
        each([(s, o) for s, o in said(word) if named(s)], "owl:" + word, lambda s, o, read=read: equal(s, read(o)))
    each(said("propertyChainAxiom"), "owl:propertyChainAxiom", chain)
    each(said("disjointWith"), "owl:disjointWith", disjoint)
    each(said("propertyDisjointWith"), "owl:propertyDisjointWith", pair(t.disjoint_property))
    each(said("disjointUnionOf"), "owl:disjointUnionOf", disjoint_union)
    each([(s, x.get(s, "members")) for s in typed("AllDisjointClasses")], "owl:members", lambda s, head: apart(x.items(head), disjoint))
    each([(s, x.get(s, "members")) for s in typed("AllDisjointProperties")], "owl:members", lambda s, head: apart(x.items(head), pair(t.disjoint_property)))
    each(said("hasKey"), "owl:hasKey", unknown)
    for k in ("ReflexiveProperty", "NegativePropertyAssertion"):
        each([(s, OWL + k) for s in typed(k)], "rdf:type", unknown)
    for k, into in (("SymmetricProperty", t.symmetric), ("TransitiveProperty", t.transitive), ("FunctionalProperty", t.functional), ("InverseFunctionalProperty", t.inverse_functional), ("AsymmetricProperty", t.asymmetric), ("IrreflexiveProperty", t.irreflexive)):
        into.extend(s for s in typed(k) if named(s))
    if strict and left_out:
        raise NotUnderstood(left_out)
    t.left_out = left_out
    return t


def facts_and_types(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, s, p, o) of object facts between individuals and (g, i, c) of named types, schema vocabulary left out but for
    statements that names are one or differ."""
    from ..functions.names import OWL

    vocabulary = F.col("p").startswith("http://www.w3.org/") & ~F.col("p").isin(OWL + "sameAs", OWL + "differentFrom")
    plain = triples.where(F.col("o_kind") == "iri")
    facts = plain.where(~vocabulary).select(F.col("graph_id").alias("g"), "s", "p", "o").distinct()
    types = plain.where((F.col("p") == RDF + "type") & ~F.col("o").startswith("http://www.w3.org/")).select(F.col("graph_id").alias("g"), F.col("s").alias("i"), F.col("o").alias("c")).distinct()
    return facts, types
