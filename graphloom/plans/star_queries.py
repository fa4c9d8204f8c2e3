"""Queries of the graph, closure, path, tag and question families over the star schema, each beside its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import closure, graph, paths, questions
from ..sources import star

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FACTS = """facts AS (
 SELECT 'nation_' || n_nationkey AS s, 'inRegion' AS p, 'region_' || n_regionkey AS o FROM nation
 UNION SELECT 'customer_' || c_custkey, 'inNation', 'nation_' || c_nationkey FROM customer
 UNION SELECT 'supplier_' || s_suppkey, 'inNation', 'nation_' || s_nationkey FROM supplier
 UNION SELECT 'order_' || o_orderkey, 'placedBy', 'customer_' || o_custkey FROM orders
 UNION SELECT 'order_' || l_orderkey, 'hasPart', 'part_' || l_partkey FROM lineitem
 UNION SELECT 'order_' || l_orderkey, 'suppliedBy', 'supplier_' || l_suppkey FROM lineitem)"""
TYPES = """types AS (
 SELECT 'customer_' || c_custkey AS i, regexp_replace(list_aggregate(list_transform(string_split(lower(c_mktsegment), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ''), '[^A-Za-z0-9]', '', 'g') || 'Customer' AS c FROM customer
 UNION ALL SELECT 'part_' || p_partkey, regexp_replace(list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ''), '[^A-Za-z0-9]', '', 'g') || 'Part' FROM part
 UNION ALL SELECT 'order_' || o_orderkey, 'Order' FROM orders
 UNION ALL SELECT 'supplier_' || s_suppkey, 'Supplier' FROM supplier)"""
CLOSED = f"""{FACTS}, located AS (SELECT s, o FROM facts WHERE p IN ('inNation', 'inRegion')
 UNION SELECT a.s, b.o FROM facts a JOIN facts b ON a.o = b.s WHERE a.p = 'inNation' AND b.p = 'inRegion'),
 ordered AS (SELECT DISTINCT a.s, b.o FROM facts a JOIN facts b ON a.o = b.s WHERE a.p = 'placedBy' AND b.p = 'inNation'),
 closed AS (SELECT * FROM facts UNION ALL SELECT s, 'locatedIn', o FROM located UNION ALL SELECT o, 'placed', s FROM facts WHERE p = 'placedBy'
 UNION ALL SELECT s, 'orderedFrom', o FROM ordered UNION ALL (SELECT s, 'tradesWith', o FROM ordered UNION SELECT o, 'tradesWith', s FROM ordered))"""
FAMILY = names.FAMILY


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _graph(df: DataFrame) -> DataFrame:
    return df.withColumn("g", F.lit("star"))


# ---- graph ----------------------------------------------------------------------------------------------------------
@query("g_entity_counts", f"WITH {FACTS} SELECT p, count(*) AS n_facts, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects FROM facts GROUP BY p")
def g_entity_counts(spark, d):
    return star.facts(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("s").alias("n_subjects"), F.count_distinct("o").alias("n_objects"))


@query("g_tbox", "SELECT * FROM (VALUES ('inNation', 'locatedIn'), ('inRegion', 'locatedIn'), ('orderedFrom', 'tradesWith')) t(sub, sup)")
def g_tbox(spark, d):
    return spark.createDataFrame(star.terminology().sub_property, "sub string, sup string")


@query("g_neighbours", f"WITH {FACTS}, e AS (SELECT s AS node, o AS other FROM facts WHERE p IN ('inRegion', 'inNation') UNION SELECT o, s FROM facts WHERE p IN ('inRegion', 'inNation')) SELECT node, count(*) AS n FROM e GROUP BY node")
def g_neighbours(spark, d):
    return graph.neighbours(star.facts(spark, d, ("inRegion", "inNation"))).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query("g_abox_1hop", f"WITH {FACTS}, e AS (SELECT s AS node, s, p, o FROM facts UNION SELECT o, s, p, o FROM facts) SELECT node AS root, count(*) AS n_facts FROM e WHERE node LIKE 'nation%' GROUP BY node")
def g_abox_1hop(spark, d):
    f = star.facts(spark, d, ("inRegion", "inNation"))
    roots = f.select(F.col("o").alias("root")).where("root like 'nation%'").distinct()
    more = star.facts(spark, d, ("inRegion",)).select(F.col("s").alias("root"))
    return graph.one_hop(f, roots.union(more).distinct()).groupBy("root").agg(F.count(F.lit(1)).alias("n_facts"))


@query("g_abox_2hop", f"WITH {FACTS}, f AS (SELECT * FROM facts WHERE p IN ('inRegion', 'inNation')), one AS (SELECT o AS root, s, o FROM f WHERE p = 'inRegion'), nodes AS (SELECT root, s AS node FROM one UNION SELECT root, o FROM one), e AS (SELECT s AS node, s, p, o FROM f UNION SELECT o, s, p, o FROM f), two AS (SELECT DISTINCT root, e.s, e.p, e.o FROM nodes JOIN e USING (node)) SELECT root, count(*) AS n_facts FROM two GROUP BY root")
def g_abox_2hop(spark, d):
    f = star.facts(spark, d, ("inRegion", "inNation"))
    roots = star.facts(spark, d, ("inRegion",)).select(F.col("o").alias("root")).distinct()
    return graph.two_hop(f, roots).groupBy("root").agg(F.count(F.lit(1)).alias("n_facts"))


@query("g_bfs_3hop", f"WITH {FACTS}, f AS (SELECT * FROM facts WHERE p IN ('inRegion', 'inNation', 'placedBy')), e AS (SELECT s AS a, o AS b FROM f UNION SELECT o, s FROM f), h0 AS (SELECT DISTINCT o AS root, o AS node FROM f WHERE p = 'inRegion'), h1 AS (SELECT * FROM h0 UNION SELECT root, b FROM h0 JOIN e ON node = a), h2 AS (SELECT * FROM h1 UNION SELECT root, b FROM h1 JOIN e ON node = a), h3 AS (SELECT * FROM h2 UNION SELECT root, b FROM h2 JOIN e ON node = a) SELECT x.root, count(*) AS n_facts FROM h3 x JOIN f ON x.node = f.s JOIN h3 y ON y.root = x.root AND y.node = f.o GROUP BY x.root")
def g_bfs_3hop(spark, d):
    f = star.facts(spark, d, ("inRegion", "inNation", "placedBy"))
    roots = star.facts(spark, d, ("inRegion",)).select(F.col("o").alias("root")).distinct()
    return graph.n_hop(f, roots, 3).groupBy("root").agg(F.count(F.lit(1)).alias("n_facts"))


@query("g_direct_types", f"WITH {TYPES}, n AS (SELECT i, string_agg(DISTINCT c, '_' ORDER BY c) AS names FROM types GROUP BY i) SELECT names, count(*) AS n FROM n GROUP BY names")
def g_direct_types(spark, d):
    return graph.direct_type_names(star.types(spark, d)).groupBy("names").agg(F.count(F.lit(1)).alias("n"))


@query("g_name_helpers", "SELECT page_id, CASE WHEN contains(url, '#') THEN string_split(url, '#')[-1] ELSE string_split(url, '/')[-1] END AS short_form, CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#') + 1) ELSE string_split(url, '/')[-1] END AS extractor_name, CASE WHEN regexp_extract(url, '([^#/]+)$', 1) <> '' THEN regexp_extract(url, '([^#/]+)$', 1) ELSE url END AS local_name, CASE WHEN regexp_extract(url, '^(.+[#/])[^#/]*$', 1) <> '' THEN regexp_extract(url, '^(.+[#/])[^#/]*$', 1) ELSE url END AS namespace FROM pages")
def g_name_helpers(spark, d):
    u = F.col("url")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", names.short_form(u).alias("short_form"), names.extractor_name(u).alias("extractor_name"), names.local_name(u).alias("local_name"), names.namespace(u).alias("namespace"))


# ---- closure --------------------------------------------------------------------------------------------------------
def closed_facts(spark, d) -> DataFrame:
    return closure.close_facts(_graph(star.facts(spark, d)), star.terminology())


@query("r_closure_facts", f"WITH {CLOSED} SELECT p, count(*) AS n, count(DISTINCT s) AS n_subjects FROM closed GROUP BY p")
def r_closure_facts(spark, d):
    return closed_facts(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("n_subjects"))


@query("r_transitive", f"WITH {CLOSED} SELECT s, o FROM located")
def r_transitive(spark, d):
    f = _graph(star.facts(spark, d, ("inRegion", "inNation")))
    return closure.close_facts(f, star.terminology()).where("p = 'locatedIn'").select("s", "o")


@query("r_chain", f"WITH {CLOSED} SELECT s, o FROM ordered")
def r_chain(spark, d):
    t = closure.Terminology(chains=star.terminology().chains)
    return closure.close_facts(_graph(star.facts(spark, d, ("placedBy", "inNation"))), t).where("p = 'orderedFrom'").select("s", "o")


@query("r_inverse_symmetric", f"WITH {CLOSED} SELECT s, p, o FROM closed WHERE p IN ('placed', 'tradesWith')")
def r_inverse_symmetric(spark, d):
    return closure.close_facts(_graph(star.facts(spark, d, ("placedBy", "inNation"))), star.terminology()).where("p in ('placed', 'tradesWith')").select("s", "p", "o")


@query("r_asserted_vs_inferred", f"WITH {CLOSED} SELECT c.p, count(f.s) AS asserted, count(*) - count(f.s) AS inferred FROM closed c LEFT JOIN facts f ON c.s = f.s AND c.p = f.p AND c.o = f.o GROUP BY c.p")
def r_asserted_vs_inferred(spark, d):
    told = star.facts(spark, d).select("s", "p", "o", F.lit(1).alias("told"))
    return closed_facts(spark, d).join(told, ["s", "p", "o"], "left").groupBy("p").agg(F.count("told").alias("asserted"), (F.count(F.lit(1)) - F.count("told")).alias("inferred"))


@query("r_closure_types", f"WITH {FACTS}, {TYPES}, up AS (SELECT i, c FROM types UNION SELECT i, 'Customer' FROM types WHERE c LIKE '%Customer' UNION SELECT i, 'Part' FROM types WHERE c LIKE '%Part' UNION SELECT i, 'Party' FROM types WHERE c LIKE '%Customer' OR c = 'Supplier' UNION SELECT i, 'Client' FROM types WHERE c LIKE '%Customer' UNION SELECT s, 'GoodsOrder' FROM facts JOIN types ON o = i WHERE p = 'hasPart' AND c LIKE '%Part' UNION SELECT s, 'Order' FROM facts WHERE p IN ('placedBy', 'suppliedBy') UNION SELECT o, x FROM facts CROSS JOIN (VALUES ('Customer'), ('Client'), ('Party')) v(x) WHERE p = 'placedBy') SELECT c, count(*) AS n FROM up GROUP BY c")
def r_closure_types(spark, d):
    t = star.terminology(spark, d)
    facts = closure.expand_facts(_graph(star.facts(spark, d, ("placedBy", "suppliedBy", "hasPart"))), t)
    return closure.close_types(_graph(star.types(spark, d)), facts, t).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@query("r_violations", f"WITH {FACTS} SELECT 'functional' AS rule, s AS x, p AS y FROM facts WHERE p = 'suppliedBy' GROUP BY s, p HAVING count(*) > 1")
def r_violations(spark, d):
    t = closure.Terminology(functional=["placedBy", "suppliedBy"], disjoint=[("Customer", "Part")], irreflexive=["placedBy"], asymmetric=["placedBy"])
    f = _graph(star.facts(spark, d, ("placedBy", "suppliedBy")))
    return closure.violations(f, _graph(star.types(spark, d)), t).select("rule", "x", "y")


# ---- paths ----------------------------------------------------------------------------------------------------------
_OUT = ["s", "p", "o", "type", "complexity", "tag"]


def _shown(p: DataFrame) -> DataFrame:
    return paths.tagged(p).select("s", "p", "o", "type", F.col("complexity").cast("long").alias("complexity"), "tag", F.array_join("justifications", "; ").alias("why"))


def _sql(s, p, o, kind, n, tag, why, rest) -> str:
    return f"WITH {CLOSED}, {TYPES} SELECT {s} AS s, {p} AS p, {o} AS o, '{kind}' AS type, CAST({n} AS BIGINT) AS complexity, '{tag}' AS tag, {why} AS why {rest}"


@query("e_direct", _sql("s", "p", "o", "DIRECT_ASSERTION", 1, "D", "s || ' ' || p || ' ' || o", "FROM facts WHERE p IN ('placedBy', 'inNation')"))
def e_direct(spark, d):
    return _shown(paths.direct(star.facts(spark, d, ("placedBy", "inNation"))))


@query("e_direct_type", _sql("i", "'rdf:type'", "c", "DIRECT_ASSERTION", 1, "D", "i || ' rdf:type ' || c || ' (direct assertion)'", "FROM types"))
def e_direct_type(spark, d):
    return _shown(paths.direct_type(star.types(spark, d)))


@query("e_sub_property", _sql("s", "'locatedIn'", "o", "SUBPROPERTY", 2, "DHH", "s || ' ' || p || ' ' || o || '; ' || p || ' rdfs:subPropertyOf locatedIn'", "FROM facts WHERE p IN ('inNation', 'inRegion')"))
def e_sub_property(spark, d):
    return _shown(paths.sub_property(star.facts(spark, d, ("inNation", "inRegion")), star.terminology()))


@query("e_symmetric", _sql("o", "p", "s", "SYMMETRIC_PROPERTY", 2, "DSS", "s || ' ' || p || ' ' || o || '; SymmetricObjectProperty(' || p || ')'", "FROM closed WHERE p = 'tradesWith'"))
def e_symmetric(spark, d):
    return _shown(paths.symmetric(closure.close_facts(_graph(star.facts(spark, d, ("placedBy", "inNation"))), star.terminology()), star.terminology()))


@query("e_inverse", _sql("o", "'placed'", "s", "INVERSE_PROPERTY", 2, "DII", "s || ' placedBy ' || o || '; placed owl:inverseOf placedBy'", "FROM facts WHERE p = 'placedBy'"))
def e_inverse(spark, d):
    return _shown(paths.inverse(star.facts(spark, d, ("placedBy",)), star.terminology()))


@query("e_transitive", _sql("s", "'locatedIn'", "o", "TRANSITIVE_PROPERTY", 3, "DDTT", "s || ' locatedIn ' || m || '; ' || m || ' locatedIn ' || o || '; TransitiveObjectProperty(locatedIn)'", "FROM (SELECT a.s, min(a.o) AS m, b.o FROM located a JOIN located b ON a.o = b.s GROUP BY a.s, b.o)"))
def e_transitive(spark, d):
    return _shown(paths.transitive(closure.close_facts(_graph(star.facts(spark, d, ("inRegion", "inNation"))), star.terminology()), star.terminology()))


@query("e_chain", _sql("s", "'orderedFrom'", "o", "PROPERTY_CHAIN", 3, "DDNN", "s || ' placedBy ' || m || '; ' || m || ' inNation ' || o || '; placedBy ∘ inNation → orderedFrom'", "FROM (SELECT a.s, min(a.o) AS m, b.o FROM facts a JOIN facts b ON a.o = b.s WHERE a.p = 'placedBy' AND b.p = 'inNation' GROUP BY a.s, b.o)"))
def e_chain(spark, d):
    return _shown(paths.chain(star.facts(spark, d, ("placedBy", "inNation")), star.terminology()))


@query("e_domain", _sql("s", "'rdf:type'", "'Order'", "DOMAIN_RANGE", 2, "DR", "s || ' ' || p || ' ' || v || '; domain(' || p || ') = Order'", "FROM (SELECT s, p, min(o) AS v FROM facts WHERE p IN ('placedBy', 'suppliedBy') GROUP BY s, p)"))
def e_domain(spark, d):
    return _shown(paths.domain(star.facts(spark, d, ("placedBy", "suppliedBy")), star.terminology()))


@query("e_range", _sql("o", "'rdf:type'", "'Customer'", "DOMAIN_RANGE", 2, "DR", "x || ' placedBy ' || o || '; range(placedBy) = Customer'", "FROM (SELECT o, min(s) AS x FROM facts WHERE p = 'placedBy' GROUP BY o)"))
def e_range(spark, d):
    return _shown(paths.range_(star.facts(spark, d, ("placedBy",)), star.terminology()))


@query("e_range_all", _sql("o", "'rdf:type'", "'Customer'", "DOMAIN_RANGE", 2, "DR", "s || ' placedBy ' || o || '; range(placedBy) = Customer'", "FROM facts WHERE p = 'placedBy'"))
def e_range_all(spark, d):
    return _shown(paths.range_(star.facts(spark, d, ("placedBy",)), star.terminology(), every=True))


@query("e_sub_class", _sql("i", "'rdf:type'", "sup", "SUBSUMPTION", 2, "DHH", "i || ' rdf:type ' || c || '; ' || c || ' SubClassOf ' || sup", "FROM (SELECT i, c, CASE WHEN c = 'Supplier' THEN 'Party' WHEN c LIKE '%Part' THEN 'Part' ELSE 'Customer' END AS sup FROM types WHERE c <> 'Order')"))
def e_sub_class(spark, d):
    return _shown(paths.sub_class(star.types(spark, d), star.terminology(spark, d)))


@query("e_equivalent", _sql("o", "'rdf:type'", "'Client'", "EQUIVALENT_CLASS", 2, "DQQ", "o || ' rdf:type Customer; Client owl:equivalentClass Customer'", "FROM (SELECT DISTINCT o FROM facts WHERE p = 'placedBy')"))
def e_equivalent(spark, d):
    t = star.facts(spark, d, ("placedBy",)).select(F.col("o").alias("i"), F.lit("Customer").alias("c")).distinct()
    return _shown(paths.equivalent_class(t, star.terminology()))


@query("e_existential", _sql("s", "'rdf:type'", "'GoodsOrder'", "EXISTENTIAL", 3, "DDEE", "s || ' hasPart ' || v || '; ' || v || ' rdf:type Part; hasPart someValuesFrom Part'", "FROM (SELECT s, min(o) AS v FROM facts JOIN types ON o = i WHERE p = 'hasPart' AND c LIKE '%Part' GROUP BY s)"))
def e_existential(spark, d):
    t = star.terminology(spark, d)
    types = closure.expand_types(_graph(star.types(spark, d).where("c like '%Part'")), t)
    return _shown(paths.existential(star.facts(spark, d, ("hasPart",)), types, t))


@query("e_union", _sql("i", "'rdf:type'", "'Place'", "UNION", 2, "DUU", "i || ' rdf:type ' || c || '; Place unionOf ' || c", "FROM (SELECT DISTINCT o AS i, CASE WHEN p = 'inNation' THEN 'Nation' ELSE 'Region' END AS c FROM facts WHERE p IN ('inNation', 'inRegion'))"))
def e_union(spark, d):
    f = star.facts(spark, d, ("inNation", "inRegion")).select(F.col("o").alias("i"), F.when(F.col("p") == "inNation", "Nation").otherwise("Region").alias("c")).distinct()
    return _shown(paths.union(f, star.terminology()))


@query("e_universal", _sql("s", "'rdf:type'", "'GoodsOnly'", "UNIVERSAL", 2, "DLL", "s || ' hasPart ' || v || '; hasPart allValuesFrom Part'", "FROM (SELECT s, min(o) AS v FROM facts LEFT JOIN types ON o = i AND c LIKE '%Part' WHERE p = 'hasPart' GROUP BY s HAVING count(*) = count(i))"))
def e_universal(spark, d):
    t = star.terminology(spark, d)
    types = closure.expand_types(_graph(star.types(spark, d).where("c like '%Part'")), t)
    return _shown(paths.universal(star.facts(spark, d, ("hasPart",)), types, [("GoodsOnly", "hasPart", "Part")]))


@query("e_inverse_domain", _sql("o", "'rdf:type'", "'Order'", "INVERSE_PROPERTY", 3, "DIIRM", "s || ' placed ' || o || '; placedBy owl:inverseOf placed; domain(placedBy) = Order'", "FROM closed WHERE p = 'placed'"))
def e_inverse_domain(spark, d):
    f = closure.expand_facts(_graph(star.facts(spark, d, ("placedBy",))), star.terminology())
    return _shown(paths.inverse_domain(f, star.terminology()))


@query("e_sub_property_domain", _sql("s", "'rdf:type'", "'Located'", "SUBPROPERTY", 3, "DHHRM", "s || ' ' || p || ' ' || v || '; ' || p || ' rdfs:subPropertyOf locatedIn; domain(locatedIn) = Located'", "FROM (SELECT s, p, min(o) AS v FROM facts WHERE p IN ('inNation', 'inRegion') GROUP BY s, p)"))
def e_sub_property_domain(spark, d):
    t = closure.Terminology(sub_property=star.terminology().sub_property, domain=[("locatedIn", "Located")])
    return _shown(paths.sub_property_domain(star.facts(spark, d, ("inNation", "inRegion")), t))


@query("e_symmetric_domain", _sql("o", "'rdf:type'", "'Trader'", "SYMMETRIC_PROPERTY", 3, "DSSRM", "x || ' tradesWith ' || o || '; SymmetricObjectProperty(tradesWith); domain(tradesWith) = Trader'", "FROM (SELECT o, min(s) AS x FROM closed WHERE p = 'tradesWith' GROUP BY o)"))
def e_symmetric_domain(spark, d):
    f = closure.close_facts(_graph(star.facts(spark, d, ("placedBy", "inNation"))), star.terminology())
    return _shown(paths.symmetric_domain(f, closure.Terminology(symmetric=["tradesWith"], domain=[("tradesWith", "Trader")])))


@query("e_chain_domain", _sql("s", "'rdf:type'", "'ForeignOrder'", "PROPERTY_CHAIN", 4, "DDNNRM", "s || ' placedBy ' || m || '; ' || m || ' inNation ' || o || '; placedBy ∘ inNation → orderedFrom; domain(orderedFrom) = ForeignOrder'", "FROM (SELECT a.s, a.o AS m, min(b.o) AS o FROM facts a JOIN facts b ON a.o = b.s WHERE a.p = 'placedBy' AND b.p = 'inNation' GROUP BY a.s, a.o)"))
def e_chain_domain(spark, d):
    t = closure.Terminology(chains=star.terminology().chains, domain=[("orderedFrom", "ForeignOrder")])
    return _shown(paths.chain_domain(star.facts(spark, d, ("placedBy", "inNation")), t))


@query("e_functional_range", _sql("o", "'rdf:type'", "'Customer'", "FUNCTIONAL_PROPERTY", 3, "DFFRM", "x || ' placedBy ' || o || '; FunctionalObjectProperty(placedBy); range(placedBy) = Customer'", "FROM (SELECT o, min(s) AS x FROM facts WHERE p = 'placedBy' GROUP BY o)"))
def e_functional_range(spark, d):
    return _shown(paths.functional_range(star.facts(spark, d, ("placedBy",)), star.terminology()))


@query("e_intersection", _sql("i", "'rdf:type'", "'SupplierParty'", "INTERSECTION", 3, "DD∩∩", "i || ' rdf:type Party; ' || i || ' rdf:type Supplier; SupplierParty intersectionOf Party, Supplier'", "FROM types WHERE c = 'Supplier'"))
def e_intersection(spark, d):
    t = closure.Terminology(sub_class=[("Supplier", "Party")], intersections=[("SupplierParty", ["Supplier", "Party"])])
    types = closure.expand_types(_graph(star.types(spark, d).where("c = 'Supplier'")), closure.Terminology(sub_class=t.sub_class))
    return _shown(paths.intersection(types, t))


@query("e_sub_class_paths", f"WITH {TYPES}, w AS (SELECT c, n FROM (SELECT c, CASE WHEN c LIKE '%Customer' THEN 3 WHEN c LIKE '%Part' OR c = 'Supplier' THEN 1 ELSE 0 END AS n FROM types)) SELECT c, CAST(sum(n) AS BIGINT) AS n FROM w WHERE n > 0 GROUP BY c")
def e_sub_class_paths(spark, d):
    p = paths.sub_class_paths(star.types(spark, d), star.terminology(spark, d))
    return p.groupBy(F.substring_index(F.element_at("axioms", 1)["text"], " ", -1).alias("c")).agg(F.count(F.lit(1)).alias("n"))


@query("e_dedup", _sql("o", "'rdf:type'", "'Customer'", "DOMAIN_RANGE", 2, "DR", "x || ' placedBy ' || o || '; range(placedBy) = Customer'", "FROM (SELECT DISTINCT o, s AS x FROM facts WHERE p = 'placedBy')"))
def e_dedup(spark, d):
    f, t = star.facts(spark, d, ("placedBy",)), star.terminology()
    return _shown(paths.deduplicated(paths.range_(f, t, every=True).unionByName(paths.range_(f, t))))


# ---- tags -----------------------------------------------------------------------------------------------------------
_TEXTS = ["x rdf:type C", "C rdfs:subClassOf D", "C owl:equivalentClass D", "domain(p) = C", "TransitiveObjectProperty(p)", "AsymmetricObjectProperty(p)", "IrreflexiveObjectProperty(p)", "p owl:inverseOf q", "FunctionalObjectProperty(p)", "C owl:disjointWith D", "p1 ∘ p2 → q", "p someValuesFrom D", "p allValuesFrom D", "p min 2 D", "member of all of C, D", "C unionOf D", "C complementOf D", "unknown form", "ada isSisterOf b", ""]
_LETTERS = ["D", "H", "Q", "R", "T", "S", "V", "I", "F", "J", "N", "E", "L", "C", "∩", "U", "¬", "", "D", ""]
_KINDS = ["OTHER", "HIERARCHY", "EQUIVALENCE", "DOMAIN_RANGE", "TRANSITIVITY", "SYMMETRY", "OTHER", "INVERSE", "FUNCTIONAL", "DISJOINT", "OTHER", "EXISTENTIAL", "UNIVERSAL", "OTHER", "OTHER", "UNION", "OTHER", "OTHER", "OTHER", "OTHER"]


def _listing(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


@query("t_text_tag", f"SELECT p_partkey, {_listing(_LETTERS)}[p_partkey % 20 + 1] AS letter, {_listing(_KINDS)}[p_partkey % 20 + 1] AS kind FROM part")
def t_text_tag(spark, d):
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % 20 + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", names.text_tag(text).alias("letter"), names.text_kind(text).alias("kind"))


@query("t_axiom_tag", f"SELECT p_partkey, {_listing(list(names.AXIOM_TAGS.values()))}[p_partkey % {len(names.AXIOM_TAGS)} + 1] AS letter FROM part")
def t_axiom_tag(spark, d):
    kind = F.element_at(F.array(*map(F.lit, names.AXIOM_TAGS)), (F.col("p_partkey") % len(names.AXIOM_TAGS) + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", names.axiom_tag(kind, F.lit("")).alias("letter"))


@query("t_tag_lengths", f"WITH {FACTS} SELECT s, CAST(2 AS BIGINT) AS least, CAST(5 AS BIGINT) AS most FROM (SELECT DISTINCT s FROM facts WHERE p = 'placedBy')")
def t_tag_lengths(spark, d):
    f, t = star.facts(spark, d, ("placedBy",)), star.terminology()
    turned = closure.expand_facts(_graph(f), t)
    every = paths.tagged(paths.domain(f, t).unionByName(paths.inverse_domain(turned, t)))
    return every.groupBy("s").agg(F.min(F.length("tag")).cast("long").alias("least"), F.max(F.length("tag")).cast("long").alias("most"))


# ---- questions ------------------------------------------------------------------------------------------------------
def _rooted(spark, d) -> DataFrame:
    return star.facts(spark, d, ("placedBy", "suppliedBy")).withColumn("root", F.col("s"))


@query("q_ask", f"WITH {FACTS} SELECT '1hop-' || s || '_' || s || '-' || s || '-' || p || '-BIN' AS task_id, s AS root, 'Property Assertion' AS task_type, 'BIN' AS answer_type, 'ASK WHERE {{ <{FAMILY}' || s || '> <{FAMILY}' || p || '> <{FAMILY}' || o || '> }}' AS query, p, 'TRUE' AS answer, s || '|' || p || '|' || o AS key FROM facts WHERE p IN ('placedBy', 'suppliedBy')")
def q_ask(spark, d):
    return questions.ask_rows(_rooted(spark, d))


@query("q_select_mc", f"WITH {FACTS}, g AS (SELECT s, p, string_agg(o, '; ' ORDER BY o) AS answer FROM facts WHERE p = 'suppliedBy' GROUP BY s, p HAVING count(*) > 1) SELECT '1hop-' || s || '_' || s || '-' || s || '-' || p || '-MC' AS task_id, s AS root, 'Property Assertion' AS task_type, 'MC' AS answer_type, 'SELECT ?x WHERE {{ <{FAMILY}' || s || '> <{FAMILY}' || p || '> ?x }}' AS query, p, answer, s || '|' || p || '|' || o AS key FROM facts JOIN g USING (s, p)")
def q_select_mc(spark, d):
    return questions.select_rows(star.facts(spark, d, ("suppliedBy",)).withColumn("root", F.col("s")))


@query("q_first_wins", f"WITH {FACTS}, e AS (SELECT s AS root, s, p, o FROM facts WHERE p = 'placedBy' UNION ALL SELECT o, s, p, o FROM facts WHERE p = 'placedBy') SELECT min(root) AS root, s, p, o FROM e GROUP BY s, p, o")
def q_first_wins(spark, d):
    f = star.facts(spark, d, ("placedBy",))
    return questions.first_wins(f.withColumn("root", F.col("s")).unionByName(f.withColumn("root", F.col("o")))).select("root", "s", "p", "o")


@query("q_task_ids", f"WITH {FACTS} SELECT s || '|' || p || '|' || o AS key, '1hop-' || s || '_' || s || '-' || s || '-' || p || '-BIN' || CASE WHEN count(*) OVER (PARTITION BY s, p) > 1 THEN ',1hop-' || s || '_' || s || '-' || s || '-' || p || '-MC' ELSE '' END AS task_ids, CAST(CASE WHEN count(*) OVER (PARTITION BY s, p) > 1 THEN 2 ELSE 1 END AS BIGINT) AS n FROM facts WHERE p IN ('placedBy', 'suppliedBy')")
def q_task_ids(spark, d):
    f = _rooted(spark, d)
    return questions.task_ids(questions.ask_rows(f).unionByName(questions.select_rows(f)))


@query("q_full_uri", f"SELECT p_partkey, [ '{names.RDF}type', '{names.RDFS}label', '{names.OWL}Thing', '{FAMILY}' || p_name ][p_partkey % 4 + 1] AS uri FROM part")
def q_full_uri(spark, d):
    short = F.element_at(F.array(F.lit("rdf:type"), F.lit("rdfs:label"), F.lit("owl:Thing"), F.col("p_name")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", names.full_uri(short).alias("uri"))


@query("q_builder", "SELECT page_id, 'ASK WHERE { ' || CASE WHEN page_id % 3 = 0 THEN '?s' ELSE '<' || url || '>' END || ' ' || CASE WHEN page_id % 2 = 0 THEN 'a' ELSE '<http://x/p>' END || ' ' || CASE WHEN page_id % 5 = 0 THEN '?o' ELSE '\"v' || page_id || '\"' END || ' }' AS q FROM pages")
def q_builder(spark, d):
    n = F.col("page_id")
    q = names.pattern_query("ASK", F.when(n % 3 != 0, F.col("url")), F.when(n % 2 == 0, F.lit("rdf:type")).otherwise(F.lit("http://x/p")), F.when(n % 5 != 0, F.concat(F.lit("v"), n.cast("string"))))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", q.alias("q"))


@query("q_explanation_json", f"""WITH {FACTS} SELECT o || '|placed|' || s AS key, '{{"inferred":{{"subject":"' || o || '","predicate":"placed","object":"' || s || '"}},"explanations":[["' || s || ' placedBy ' || o || '","placed owl:inverseOf placedBy","TAG:DII"]],"size":{{"min":2,"max":2}},"explanationCount":1,"taskIds":["1hop-' || o || '_' || o || '-' || o || '-placed-BIN"],"sparqlQueries":["ASK WHERE {{ <{FAMILY}' || o || '> <{FAMILY}placed> <{FAMILY}' || s || '> }}"]}}' AS document FROM facts WHERE p = 'placedBy'""")
def q_explanation_json(spark, d):
    p = paths.tagged(paths.inverse(star.facts(spark, d, ("placedBy",)), star.terminology()))
    asks = questions.ask_rows(p.select("s", "p", "o").withColumn("root", F.col("s")))
    return questions.explanations(p, asks)


@query("q_totals", f"WITH {FACTS}, f AS (SELECT *, count(*) OVER (PARTITION BY s, p) AS n FROM facts WHERE p IN ('placedBy', 'suppliedBy')) SELECT p, count(*) AS bin, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS mc FROM f GROUP BY p")
def q_totals(spark, d):
    f = _rooted(spark, d)
    q = questions.ask_rows(f).unionByName(questions.select_rows(f))
    return q.groupBy("p").agg(F.count(F.when(F.col("answer_type") == "BIN", 1)).alias("bin"), F.count(F.when(F.col("answer_type") == "MC", 1)).alias("mc"))
