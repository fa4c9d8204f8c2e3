"""Queries of equality, nested expressions, long chains and proofs over the tables, each beside its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import closure, graph, hierarchy, paths, provenance, reasoner, rules
from ..sources import files, named_files, rdf, star, triples
from .materialise import new_dir
from .more_queries import schema
from .star_queries import FACTS, TYPES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _table(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _graph(df: DataFrame) -> DataFrame:
    return df.withColumn("g", F.lit("star"))


def _no_types(spark) -> DataFrame:
    return spark.createDataFrame([], "g string, i string, c string")


@query("r_same_as", """
    WITH RECURSIVE d AS (SELECT 'document_' || doc_id AS n, md5(text) AS h, 'source_' || source AS src FROM documents WHERE text IS NOT NULL),
    docs AS (SELECT n AS node, min(n) OVER (PARTITION BY h) AS rep FROM d),
    links AS (SELECT DISTINCT a.src AS a, b.src AS b FROM d a JOIN d b ON a.h = b.h),
    reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT l.b, r.seen FROM reach r JOIN links l ON l.a = r.node),
    sources AS (SELECT node, min(seen) AS rep FROM reach GROUP BY node)
    SELECT node, rep FROM docs WHERE node <> rep UNION ALL SELECT node, rep FROM sources WHERE node <> rep""")
def r_same_as(spark, d):
    """Documents of one text are one (an inverse functional property), and so are the sources of one document (a functional one)."""
    docs = _table(spark, d, "documents").where("text IS NOT NULL")
    name, edge = F.concat(F.lit("document_"), F.col("doc_id").cast("string")), lambda p, o: [F.lit(p).alias("p"), o.alias("o")]
    facts = docs.select(name.alias("s"), *edge("hasText", F.md5("text"))).unionByName(docs.select(name.alias("s"), *edge("fromSource", F.concat(F.lit("source_"), "source"))))
    closed = reasoner.closure(_graph(facts), _no_types(spark), closure.Terminology(inverse_functional=["hasText"], functional=["fromSource"]))
    return closed.same.select("node", "rep")


@query("r_max_cardinality", """
    WITH RECURSIVE tiny AS (SELECT DISTINCT l_orderkey AS k, 'part_' || l_partkey AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size <= 2 AND o_orderpriority = '1-URGENT'),
    links AS (SELECT DISTINCT a.n AS a, b.n AS b FROM tiny a JOIN tiny b ON a.k = b.k),
    reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT l.b, r.seen FROM reach r JOIN links l ON l.a = r.node)
    SELECT node, min(seen) AS rep FROM reach GROUP BY node HAVING min(seen) <> node""")
def r_max_cardinality(spark, d):
    """An urgent order has one tiny part at most: the tiny parts of one are the same."""
    facts = _graph(star.facts(spark, d, ("hasPart",)))
    urgent = _table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("i"), F.lit("UrgentOrder").alias("c"))
    tiny = _table(spark, d, "part").where("p_size <= 2").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("i"), F.lit("TinyPart").alias("c"))
    closed = reasoner.closure(facts, _graph(urgent.unionByName(tiny)), closure.Terminology(expressions=[("UrgentOrder", ("max", 1, "hasPart", "TinyPart"))]))
    return closed.same.select("node", "rep")


@query("r_nested", f"""
    WITH {FACTS}, {TYPES}, target AS (
        SELECT DISTINCT a.s AS i FROM facts a JOIN facts b ON a.o = b.s AND b.p = 'inNation' JOIN facts c ON b.o = c.s AND c.p = 'inRegion' AND c.o = 'region_1'
        JOIN types t ON t.i = a.o AND t.c IN ('BuildingCustomer', 'MachineryCustomer') WHERE a.p = 'placedBy')
    SELECT i, 'type' AS p, 'TargetOrder' AS v FROM target UNION ALL SELECT i, 'type', 'AuditedOrder' FROM target UNION ALL SELECT i, 'handledBy', 'desk_1' FROM target""")
def r_nested(spark, d):
    """Orders by an expression four levels deep, what that entails by name, and through successors without one."""
    wanted = ("and", "Order", ("some", "placedBy", ("and", ("some", "inNation", ("some", "inRegion", ("one", "region_1"))), ("or", "BuildingCustomer", "MachineryCustomer"))))
    t = closure.Terminology(expressions=[
        (wanted, "TargetOrder"), ("TargetOrder", ("and", ("value", "handledBy", "desk_1"), ("some", "follows", ("and", "Review", ("some", "leadsTo", "Audit"))))),
        (("some", "follows", ("some", "leadsTo", "Audit")), "AuditedOrder"),
    ])
    closed = reasoner.closure(_graph(star.facts(spark, d, ("placedBy", "inNation", "inRegion"))), _graph(star.types(spark, d)), t)
    types = closed.types.where(F.col("c").isin("TargetOrder", "AuditedOrder")).select("i", F.lit("type").alias("p"), F.col("c").alias("v"))
    return types.unionByName(closed.facts.where("p = 'handledBy'").select(F.col("s").alias("i"), "p", F.col("o").alias("v")))


@query("r_chain_long", f"""
    WITH RECURSIVE {FACTS}, steps(k, p) AS (VALUES (1, 'placedBy'), (2, 'inNation'), (3, 'inRegion')), walk AS (
        SELECT DISTINCT o AS s, s AS o, 1 AS k FROM facts WHERE p = 'suppliedBy'
        UNION SELECT w.s, f.o, w.k + 1 FROM walk w JOIN steps t ON t.k = w.k JOIN facts f ON f.p = t.p AND f.s = w.o)
    SELECT s, o FROM walk WHERE k = 4""")
def r_chain_long(spark, d):
    """Which regions a supplier serves: a chain of four properties, the first an inverse."""
    t = closure.Terminology(inverse=[("supplies", "suppliedBy")], chains=[("supplies", "placedBy", "inNation", "inRegion", "serves")])
    facts = _graph(star.facts(spark, d, ("suppliedBy", "placedBy", "inNation", "inRegion")))
    # backwards: an order has one region in the end, while a supplier has as many customers as orders
    return reasoner.closure(facts, _no_types(spark), rules.compiled(t, backwards=True), wanted={"serves"}).facts.where("p = 'serves'").select("s", "o")


#: All ways to derive what the star's terminology entails from three predicates, each with its tag.
_WAYS = f"""{FACTS}, f AS (SELECT s, p, o, s || ' ' || p || ' ' || o AS t FROM facts WHERE p IN ('placedBy', 'inNation', 'inRegion')),
    two AS (SELECT a.s, b.o, a.t AS t1, b.t AS t2 FROM f a JOIN f b ON a.o = b.s AND a.p = 'placedBy' AND b.p = 'inNation'),
    located AS (SELECT a.s, b.o, a.t AS t1, b.t AS t2 FROM f a JOIN f b ON a.o = b.s AND a.p = 'inNation' AND b.p = 'inRegion'),
    ways AS (
        SELECT s, p, o, [t] AS proof FROM f
        UNION ALL SELECT o, 'placed', s, [t, 'placed owl:inverseOf placedBy'] FROM f WHERE p = 'placedBy'
        UNION ALL SELECT s, 'rdf:type', 'Order', [t, 'domain(placedBy) = Order'] FROM f WHERE p = 'placedBy'
        UNION ALL SELECT o, 'rdf:type', 'Customer', [t, 'range(placedBy) = Customer'] FROM f WHERE p = 'placedBy'
        UNION ALL SELECT o, 'rdf:type', 'Party', [t, 'range(placedBy) = Customer', 'Customer SubClassOf Party'] FROM f WHERE p = 'placedBy'
        UNION ALL SELECT o, 'rdf:type', 'Client', [t, 'range(placedBy) = Customer', 'Client owl:equivalentClass Customer'] FROM f WHERE p = 'placedBy'
        UNION ALL SELECT s, 'locatedIn', o, [t, p || ' rdfs:subPropertyOf locatedIn'] FROM f WHERE p <> 'placedBy'
        UNION ALL SELECT s, 'locatedIn', o, [t1, t2, 'inNation rdfs:subPropertyOf locatedIn', 'inRegion rdfs:subPropertyOf locatedIn', 'TransitiveObjectProperty(locatedIn)'] FROM located
        UNION ALL SELECT s, 'orderedFrom', o, [t1, t2, 'placedBy ∘ inNation → orderedFrom'] FROM two
        UNION ALL SELECT s, 'tradesWith', o, [t1, t2, 'placedBy ∘ inNation → orderedFrom', 'orderedFrom rdfs:subPropertyOf tradesWith'] FROM two
        UNION ALL SELECT o, 'tradesWith', s, [t1, t2, 'placedBy ∘ inNation → orderedFrom', 'orderedFrom rdfs:subPropertyOf tradesWith', 'SymmetricObjectProperty(tradesWith)'] FROM two),
    ranked AS (SELECT s, p, o, list_sort(proof) AS proof, len(proof) AS size, row_number() OVER (PARTITION BY s, p, o ORDER BY len(proof), list_sort(proof)) AS rank FROM ways)"""


#: All ways to derive what the star's terminology entails from all facts and types. None contains another.
_EVERY_WAY = f"""{FACTS}, {TYPES}, f AS (SELECT s, p, o, s || ' ' || p || ' ' || o AS t FROM facts WHERE s IS NOT NULL AND o IS NOT NULL),
    told AS (SELECT DISTINCT i, c, i || ' rdf:type ' || c AS t FROM types WHERE i IS NOT NULL AND c IS NOT NULL),
    two AS (SELECT a.s, b.o, a.t AS t1, b.t AS t2 FROM f a JOIN f b ON a.o = b.s AND a.p = 'placedBy' AND b.p = 'inNation'),
    located AS (SELECT a.s, b.o, a.t AS t1, b.t AS t2 FROM f a JOIN f b ON a.o = b.s AND a.p = 'inNation' AND b.p = 'inRegion'),
    customers AS (
        SELECT i, [t] AS proof FROM told WHERE c = 'Customer'
        UNION ALL SELECT i, [t, c || ' SubClassOf Customer'] FROM told WHERE c LIKE '%_Customer'
        UNION ALL SELECT o, [t, 'range(placedBy) = Customer'] FROM f WHERE p = 'placedBy'),
    parts AS (SELECT i, [t] AS proof FROM told WHERE c = 'Part' UNION ALL SELECT i, [t, c || ' SubClassOf Part'] FROM told WHERE c LIKE '%_Part'),
    ways AS (
        SELECT s, p, o, [t] AS proof FROM f
        UNION ALL SELECT i, 'rdf:type', c, [t] FROM told
        UNION ALL SELECT o, 'placed', s, [t, 'placed owl:inverseOf placedBy'] FROM f WHERE p = 'placedBy'
        UNION ALL SELECT s, 'rdf:type', 'Order', [t, 'domain(' || p || ') = Order'] FROM f WHERE p IN ('placedBy', 'suppliedBy')
        UNION ALL SELECT i, 'rdf:type', 'Customer', proof FROM customers WHERE len(proof) > 1
        UNION ALL SELECT i, 'rdf:type', 'Client', list_append(proof, 'Client owl:equivalentClass Customer') FROM customers
        UNION ALL SELECT i, 'rdf:type', 'Party', list_append(proof, 'Customer SubClassOf Party') FROM customers
        UNION ALL SELECT i, 'rdf:type', 'Party', [t, 'Supplier SubClassOf Party'] FROM told WHERE c = 'Supplier'
        UNION ALL SELECT i, 'rdf:type', 'Part', proof FROM parts WHERE len(proof) > 1
        UNION ALL SELECT f.s, 'rdf:type', 'GoodsOrder', list_concat(x.proof, [f.t, 'hasPart someValuesFrom Part']) FROM f JOIN parts x ON f.o = x.i WHERE f.p = 'hasPart'
        UNION ALL SELECT s, 'locatedIn', o, [t, p || ' rdfs:subPropertyOf locatedIn'] FROM f WHERE p IN ('inNation', 'inRegion')
        UNION ALL SELECT s, 'locatedIn', o, [t1, t2, 'inNation rdfs:subPropertyOf locatedIn', 'inRegion rdfs:subPropertyOf locatedIn', 'TransitiveObjectProperty(locatedIn)'] FROM located
        UNION ALL SELECT s, 'orderedFrom', o, [t1, t2, 'placedBy ∘ inNation → orderedFrom'] FROM two
        UNION ALL SELECT s, 'tradesWith', o, [t1, t2, 'placedBy ∘ inNation → orderedFrom', 'orderedFrom rdfs:subPropertyOf tradesWith'] FROM two
        UNION ALL SELECT o, 'tradesWith', s, [t1, t2, 'placedBy ∘ inNation → orderedFrom', 'orderedFrom rdfs:subPropertyOf tradesWith', 'SymmetricObjectProperty(tradesWith)'] FROM two),
    ranked AS (SELECT s, p, o, list_sort(proof) AS proof, len(proof) AS size, row_number() OVER (PARTITION BY s, p, o ORDER BY len(proof), list_sort(proof)) AS rank FROM ways)"""


def _proofs(spark, d) -> DataFrame:
    """A row a fact of the one graph: all facts and types of the tables, and what the whole terminology entails."""
    return provenance.by_fact(_graph(star.facts(spark, d)), _graph(star.types(spark, d)), star.terminology(spark, d), most=2)


@query("e_justifications", f"WITH {_EVERY_WAY} SELECT s, p, o, CAST(rank AS INTEGER) AS rank, CAST(size AS INTEGER) AS size, array_to_string(proof, '; ') AS proof FROM ranked WHERE rank <= 2")
def e_justifications(spark, d):
    """The two least proofs of every fact and type that the star's terminology entails."""
    return provenance.spread(_proofs(spark, d)).select("s", "p", "o", "rank", "size", F.array_join("proof", "; ").alias("proof"))


@query("q_explained", f"""WITH {_WAYS} SELECT s, p, o, count(*) AS explanations, CAST(min(size) AS INTEGER) AS least, CAST(max(size) AS INTEGER) AS most,
    min(CASE WHEN p IN ('placedBy', 'inNation', 'inRegion') THEN 'D' WHEN p = 'placed' THEN 'DII' WHEN o IN ('Order', 'Customer') THEN 'DR' WHEN o = 'Party' THEN 'DHHRM' WHEN o = 'Client' THEN 'DQQRM'
        WHEN p = 'locatedIn' AND size = 2 THEN 'DHH' WHEN p = 'locatedIn' THEN 'DDHHHHTTM' WHEN p = 'orderedFrom' THEN 'DDNN' WHEN size = 4 THEN 'DDHHNNM' ELSE 'DDHHSSNNM' END) AS tag
    FROM ranked WHERE rank <= 2 GROUP BY s, p, o""")
def q_explained(spark, d):
    """Every candidate fact and type of a graph with its explanations and their tag, in one run."""
    found = provenance.by_fact(_graph(star.facts(spark, d, ("placedBy", "inNation", "inRegion"))), _no_types(spark), star.terminology(), most=2)
    shown = lambda df: paths.tagged(provenance.as_paths(provenance.spread(df)))
    counts = [F.count(F.lit(1)).alias("explanations"), F.min("complexity").alias("least"), F.max("complexity").alias("most"), F.min("tag").alias("tag")]
    several = shown(found.where(F.size("proofs") > 1)).groupBy("s", "p", "o").agg(*counts)
    # a fact with one explanation needs no grouping, and most have one
    one = shown(found.where(F.size("proofs") == 1))
    return one.select("s", "p", "o", F.lit(1).cast("long").alias("explanations"), F.col("complexity").alias("least"), F.col("complexity").alias("most"), "tag").unionByName(several)


# ---- patterns and modules -------------------------------------------------------------------------------------------
@query("g_pattern", f"""WITH {FACTS} SELECT DISTINCT a.s AS "order", a.o AS customer, c.o AS supplier, b.o AS nation FROM facts a JOIN facts b ON b.s = a.o AND b.p = 'inNation' JOIN facts c ON c.s = a.s AND c.p = 'suppliedBy'
    JOIN facts e ON e.s = c.o AND e.p = 'inNation' AND e.o = b.o JOIN facts r ON r.s = b.o AND r.p = 'inRegion' AND r.o = 'region_2' WHERE a.p = 'placedBy'""")
def g_pattern(spark, d):
    """Orders whose customer and supplier are in one nation of a region: five triple patterns over a store."""
    path = new_dir(spark, "triples")
    triples.store(_graph(star.facts(spark, d)), path)
    found = triples.match(lambda **c: triples.scan(spark, path, **c), [
        ("?order", "placedBy", "?customer"), ("?customer", "inNation", "?nation"), ("?order", "suppliedBy", "?supplier"), ("?supplier", "inNation", "?nation"), ("?nation", "inRegion", "region_2"),
    ])
    return found.select("order", "customer", "supplier", "nation")


# of the terminology 32 statements are the same everywhere: 9 classes, 8 properties, 15 axioms; each kind adds 2
@query("g_module_files", f"""WITH {FACTS}, {TYPES}, kinds AS (SELECT count(DISTINCT c) AS n FROM types WHERE c LIKE '%_Customer' OR c LIKE '%_Part'),
    e AS (SELECT s AS root, s, p, o FROM facts UNION SELECT o, s, p, o FROM facts)
    SELECT root, 2 * max(n) + 32 AS axioms, count(*) AS facts FROM e, kinds WHERE root LIKE 'nation%' OR root LIKE 'supplier%' GROUP BY root""")
def g_module_files(spark, d):
    """Modules of nations and suppliers, the terminology and the facts one hop around, written as a Turtle file each under its
    root's name, and read back."""
    f, path = star.facts(spark, d), new_dir(spark, "modules")
    roots = f.select(F.explode(F.array("s", "o")).alias("root")).where("root LIKE 'nation%' OR root LIKE 'supplier%'").distinct()
    kind = [F.lit("iri").alias("o_kind"), *(F.lit(None).cast("string").alias(c) for c in ("o_dtype", "o_lang"))]
    facts = graph.one_hop(f, roots).select(F.col("root").alias("graph_id"), "s", "p", "o", *kind)
    axioms = schema(spark, d)
    lines = [r.value for r in files.turtle_lines(axioms.select(F.lit("").alias("graph_id"), "s", "p", "o", *kind)).collect()]  # a terminology
    named_files.write_graphs(facts, path, terminology=lines)
    back = rdf.read(spark, path).where("NOT s LIKE 'http://example.org/%'")
    is_axiom = F.col("p").startswith("rdf:") | F.col("p").startswith("rdfs:") | F.col("p").startswith("owl:")
    return back.groupBy(F.col("graph_id").alias("root")).agg(F.count(F.when(is_axiom, 1)).alias("axioms"), F.count(F.when(~is_axiom, 1)).alias("facts"))


_ABOVE = """edges AS (SELECT 'part_' || p_partkey AS sub, p_brand AS sup FROM part UNION SELECT 'part_' || p_partkey, 'type ' || p_type FROM part UNION SELECT p_brand, 'Part' FROM part UNION SELECT 'type ' || p_type, 'Part' FROM part
    UNION SELECT 'order_' || o_orderkey, 'status ' || o_orderstatus FROM orders UNION SELECT 'order_' || o_orderkey, 'priority ' || o_orderpriority FROM orders UNION SELECT 'status ' || o_orderstatus, 'Order' FROM orders UNION SELECT 'priority ' || o_orderpriority, 'Urgency' FROM orders
    UNION SELECT * FROM (VALUES ('Urgency', 'Order'), ('Order', 'Document'), ('Document', 'Record'), ('Record', 'Document'), ('Part', 'Thing'), ('Record', 'Thing')) v(sub, sup))"""


@query("r_class_index", f"""WITH RECURSIVE {_ABOVE}, up AS (SELECT sub AS c, sub AS d FROM edges UNION SELECT sup, sup FROM edges UNION SELECT u.c, e.sup FROM up u JOIN edges e ON e.sub = u.d)
    SELECT d AS class, count(*) - 1 AS n FROM up GROUP BY d""")
def r_class_index(spark, d):
    """How many classes each class subsumes, in a hierarchy of a class a row with several superclasses and a cycle."""
    p, o = _table(spark, d, "part"), _table(spark, d, "orders")
    name = lambda kind, c: F.concat(F.lit(f"{kind}_"), F.col(c).cast("string"))
    kind, status, level = F.concat(F.lit("type "), "p_type"), F.concat(F.lit("status "), "o_orderstatus"), F.concat(F.lit("priority "), "o_orderpriority")
    edges = p.select(name("part", "p_partkey").alias("sub"), F.col("p_brand").alias("sup")).union(p.select(name("part", "p_partkey"), kind)).union(p.select("p_brand", F.lit("Part"))).union(p.select(kind, F.lit("Part")))
    edges = edges.union(o.select(name("order", "o_orderkey"), status)).union(o.select(name("order", "o_orderkey"), level)).union(o.select(status, F.lit("Order"))).union(o.select(level, F.lit("Urgency")))
    fixed = [("Urgency", "Order"), ("Order", "Document"), ("Document", "Record"), ("Record", "Document"), ("Part", "Thing"), ("Record", "Thing")]
    return hierarchy.index(edges.union(spark.createDataFrame(fixed, "sub string, sup string"))).descendants()
