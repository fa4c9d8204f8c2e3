"""Queries of trace-back finders, class expressions, descriptions, abstraction, sizes and scoring, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import abstraction, answers, closure, describe, finders, graph, paths, sampling, verbal
from ..sources import star
from .star_queries import CLOSED, FACTS, TYPES, closed_facts
from .text_queries import _CASES, _t, cases, scored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


# ---- finders --------------------------------------------------------------------------------------------------------
_TRACES = """traced AS (SELECT s AS i, 'placedBy' AS p, 'asserted' AS kind, min(s || ' placedBy ' || o) AS evidence FROM facts WHERE p = 'placedBy' GROUP BY s
 UNION ALL SELECT s, 'suppliedBy', 'asserted', min(s || ' suppliedBy ' || o) FROM facts WHERE p = 'suppliedBy' GROUP BY s
 UNION ALL SELECT s, 'locatedIn', 'sub-property', min(s || ' ' || p || ' ' || o) FROM facts WHERE p IN ('inNation', 'inRegion') GROUP BY s
 UNION ALL SELECT o, 'placed', 'inverse', min(s || ' placedBy ' || o) FROM facts WHERE p = 'placedBy' GROUP BY o
 UNION ALL SELECT a.s, 'orderedFrom', 'chain', min(a.s || ' placedBy ' || a.o || ' and ' || b.s || ' inNation ' || b.o) FROM facts a JOIN facts b ON a.o = b.s WHERE a.p = 'placedBy' AND b.p = 'inNation' GROUP BY a.s)"""


@query("e_trace", f"WITH {FACTS}, {_TRACES} SELECT i, p, kind, evidence FROM traced WHERE p <> 'suppliedBy'")
def e_trace(spark, d):
    found = finders.traces(star.facts(spark, d), star.terminology(), ["placedBy", "locatedIn", "placed", "orderedFrom"])
    return found.select("i", "p", "kind", F.array_join("evidence", " and ").alias("evidence"))


@query("e_reverse_trace", f"WITH {FACTS} SELECT o AS i, p, min(s || ' ' || p || ' ' || o) AS evidence FROM facts WHERE p IN ('placedBy', 'inNation') GROUP BY o, p")
def e_reverse_trace(spark, d):
    return finders.reverse_traces(star.facts(spark, d), ["placedBy", "inNation"])


@query("e_domain_trace", f"WITH {FACTS}, {_TRACES} SELECT i AS s, 'Order' AS o, evidence || ' and domain(' || p || ') = Order' AS description FROM traced WHERE p IN ('placedBy', 'suppliedBy')")
def e_domain_trace(spark, d):
    return finders.domain_trace(star.facts(spark, d), star.terminology()).select("s", "o", "description")


_UP = """up AS (SELECT i, c || ' rdfs:subClassOf Customer' AS w, 'Customer' AS o, 2 AS n FROM types WHERE c LIKE '%Customer' UNION ALL SELECT i, c || ' rdfs:subClassOf Customer and Customer rdfs:subClassOf Party', 'Party', 3 FROM types WHERE c LIKE '%Customer'
 UNION ALL SELECT i, c || ' rdfs:subClassOf Part', 'Part', 2 FROM types WHERE c LIKE '%Part' UNION ALL SELECT i, 'Supplier rdfs:subClassOf Party', 'Party', 2 FROM types WHERE c = 'Supplier')"""


@query("e_class_trace", f"WITH {TYPES}, {_UP} SELECT u.i AS s, o, n AS complexity, t.i || ' rdf:type ' || c || ' and ' || w AS description FROM up u JOIN types t ON u.i = t.i")
def e_class_trace(spark, d):
    return finders.class_trace(star.types(spark, d), star.terminology(spark, d)).select("s", "o", "complexity", "description")


@query("e_hierarchical", f"WITH {TYPES}, {_UP}, every AS (SELECT o, n FROM up UNION ALL SELECT 'Client', 3 FROM types WHERE c LIKE '%Customer') SELECT o, n AS complexity, count(*) AS paths FROM every GROUP BY o, n")
def e_hierarchical(spark, d):
    return finders.class_trace(star.types(spark, d), star.terminology(spark, d), equivalents=True).groupBy("o", "complexity").agg(F.count(F.lit(1)).alias("paths"))


def _with_base(spark, d, suffix: str, base: str) -> DataFrame:
    t = star.types(spark, d)
    return t.unionByName(t.where(F.col("c").endswith(suffix)).select("i", F.lit(base).alias("c")))


@query("r_some", f"WITH {FACTS}, v AS (SELECT s, min(o) AS o FROM facts WHERE p = 'hasPart' AND o IN (SELECT 'part_' || p_partkey FROM part) GROUP BY s) SELECT s, 'GoodsOrder' AS o, s || ' hasPart ' || o || ' and ' || o || ' rdf:type Part and hasPart someValuesFrom Part' AS description FROM v")
def r_some(spark, d):
    f = star.facts(spark, d, ("hasPart",))
    return finders.existential_asserted(f, f, _with_base(spark, d, "Part", "Part"), star.types(spark, d), star.terminology()).select("s", "o", "description")


@query("r_intersection", f"WITH {TYPES} SELECT i AS s, 'LocalBuyer' AS o, i || ' rdf:type AutomobileCustomer and ' || i || ' rdf:type Party and LocalBuyer intersectionOf AutomobileCustomer, Party' AS description FROM types WHERE c = 'AutomobileCustomer'")
def r_intersection(spark, d):
    rules = [("LocalBuyer", ["AutomobileCustomer", "Party"])]
    return finders.intersection_asserted(_with_base(spark, d, "Customer", "Party"), star.types(spark, d), rules).select("s", "o", "description")


@query("r_all_values", "SELECT 'customer_' || c_custkey AS s, 'customer_' || c_custkey || ' has no value of placed and placed allValuesFrom Order' AS description FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'supplier_' || s_suppkey, 'supplier_' || s_suppkey || ' has no value of placed and placed allValuesFrom Order' FROM supplier")
def r_all_values(spark, d):
    placed = star.facts(spark, d, ("placedBy",)).select(F.col("o").alias("s"), F.lit("placed").alias("p"), F.col("s").alias("o"))
    people = star.types(spark, d).where("c like '%Customer' or c = 'Supplier'").select("i")
    return finders.universal_vacuous(people, placed, [("IdleCustomer", "placed", "Order")]).select("s", "description")


@query("e_combination", f"WITH {FACTS}, v AS (SELECT s, min(o) AS o FROM facts WHERE p = 'hasPart' AND o IN (SELECT 'part_' || p_partkey FROM part) GROUP BY s) SELECT s, 'GoodsBuy' AS o, s || ' rdf:type Order and ' || s || ' hasPart ' || o || ' with ' || o || ' rdf:type Part and GoodsBuy' AS description FROM v WHERE s IN (SELECT 'order_' || o_orderkey FROM orders)")
def e_combination(spark, d):
    return finders.combination(star.facts(spark, d, ("hasPart",)), _with_base(spark, d, "Part", "Part"), [("GoodsBuy", ["Order", ("hasPart", "Part")])]).select("s", "o", "description")


@query("e_format", f"WITH {FACTS}, {TYPES} SELECT text, count(*) AS n FROM (SELECT p || ' ' || o AS text FROM (SELECT s || ' ' || p AS p, o FROM facts) UNION ALL SELECT i || ' rdf:type ' || c FROM types UNION ALL SELECT 'domain(' || p || ') = ' || min(s[1:6]) FROM facts GROUP BY p UNION ALL SELECT 'HasKey(' || c || ' ' || i || ')' FROM types WHERE c = 'Supplier') GROUP BY text")
def e_format(spark, d):
    f, t = star.facts(spark, d), star.types(spark, d)
    rows = f.select(F.lit("ObjectPropertyAssertion").alias("k"), F.array("s", "p", "o").alias("a")).unionByName(t.select(F.lit("ClassAssertion").alias("k"), F.array("i", "c").alias("a")))
    rows = rows.unionByName(f.groupBy("p").agg(F.min(F.substring("s", 1, 6)).alias("c")).select(F.lit("ObjectPropertyDomain").alias("k"), F.array("p", "c").alias("a")))
    rows = rows.unionByName(t.where("c = 'Supplier'").select(F.lit("HasKey").alias("k"), F.array("c", "i").alias("a")))
    return rows.select(finders.format_axiom(F.col("k"), F.col("a")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("q_candidates", f"WITH {CLOSED} SELECT l.s, l.o, 1 AS n_paths, CASE WHEN f.s IS NULL THEN 3 ELSE 2 END AS complexity, CASE WHEN f.s IS NULL THEN l.s || ' locatedIn ' || m.o || ' and ' || m.o || ' locatedIn ' || l.o || ' and TransitiveObjectProperty(locatedIn)' ELSE l.s || ' ' || f.p || ' ' || l.o || ' and ' || f.p || ' rdfs:subPropertyOf locatedIn' END AS description FROM located l LEFT JOIN facts f ON l.s = f.s AND l.o = f.o AND f.p IN ('inNation', 'inRegion') LEFT JOIN facts m ON f.s IS NULL AND m.s = l.s AND m.p = 'inNation'")
def q_candidates(spark, d):
    f, t = star.facts(spark, d, ("inRegion", "inNation")), star.terminology()
    closed = closure.close_facts(f.withColumn("g", F.lit("star")), t).where("p = 'locatedIn'").select("s", "p", "o")
    found = paths.sub_property(f, t).unionByName(paths.transitive(closed, t))
    return finders.explained(closed, found).select("s", "o", F.col("n_paths").cast("int").alias("n_paths"), "complexity", "description")


@query("r_entailed", f"WITH {CLOSED}, asked AS (SELECT 'order_' || o_orderkey AS s, 'orderedFrom' AS p, 'nation_' || (o_orderkey % 25) AS o FROM orders) SELECT a.s, a.o, c.s IS NOT NULL AS holds FROM asked a LEFT JOIN (SELECT DISTINCT s, o FROM closed WHERE p = 'orderedFrom') c ON a.s = c.s AND a.o = c.o")
def r_entailed(spark, d):
    asked = _t(spark, d, "orders").select(F.concat(F.lit("order_"), "o_orderkey").alias("s"), F.lit("orderedFrom").alias("p"), F.concat(F.lit("nation_"), F.col("o_orderkey") % 25).alias("o"))
    return finders.entailed(asked, closed_facts(spark, d).where("p = 'orderedFrom'")).select("s", "o", "holds")


# ---- sizes ----------------------------------------------------------------------------------------------------------
@query("g_module_sizes", f"WITH {FACTS}, e AS (SELECT s AS root, s, p, o FROM facts UNION SELECT o, s, p, o FROM facts) SELECT root, 3 AS n_sub_properties, count(*) AS n_facts FROM e WHERE root LIKE 'nation%' OR root LIKE 'supplier%' GROUP BY root")
def g_module_sizes(spark, d):
    f = star.facts(spark, d)
    roots = f.select(F.explode(F.array("s", "o")).alias("root")).where("root like 'nation%' or root like 'supplier%'").distinct()
    axioms = spark.createDataFrame(star.terminology().sub_property, "a string, b string").agg(F.count(F.lit(1)).cast("int").alias("n_sub_properties"))
    return graph.one_hop(f, roots).groupBy("root").agg(F.count(F.lit(1)).alias("n_facts")).crossJoin(F.broadcast(axioms)).select("root", "n_sub_properties", "n_facts")


@query("g_root_class", f"WITH {TYPES} SELECT i, min(c) AS root_class FROM types GROUP BY i")
def g_root_class(spark, d):
    return star.types(spark, d).where("c <> 'Thing'").groupBy("i").agg(F.min("c").alias("root_class"))


@query("g_stats", f"WITH {FACTS}, {TYPES}, n AS (SELECT s AS x FROM facts UNION SELECT o FROM facts UNION SELECT i FROM types) SELECT (SELECT count(DISTINCT c) FROM types) AS classes, (SELECT count(DISTINCT p) FROM facts) AS properties, (SELECT count(*) FROM n) AS individuals, (SELECT count(*) FROM facts) AS facts")
def g_stats(spark, d):
    f, t = star.facts(spark, d), star.types(spark, d)
    nodes = f.select("s").union(f.select("o")).union(t.select("i")).distinct().agg(F.count(F.lit(1)).alias("individuals"))
    return t.agg(F.count_distinct("c").alias("classes")).crossJoin(f.agg(F.count_distinct("p").alias("properties"), F.count(F.lit(1)).alias("facts"))).crossJoin(nodes)  # one row each


@query("q_key_parse", f"WITH {FACTS}, k AS (SELECT s || '|' || p || '|' || o AS k FROM facts) SELECT string_split(k, '|')[2] AS p, count(*) AS n, min(string_split(k, '|')[1]) AS first, max(string_split(k, '|')[3]) AS last FROM k GROUP BY 1")
def q_key_parse(spark, d):
    parts = F.split(names.triple_key(F.col("s"), F.col("p"), F.col("o")), r"\|", 3)
    return star.facts(spark, d).select(parts.alias("k")).groupBy(F.col("k")[1].alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("k")[0]).alias("first"), F.max(F.col("k")[2]).alias("last"))


# ---- descriptions ---------------------------------------------------------------------------------------------------
def schema(spark, d) -> DataFrame:
    """The star's terminology as triples: classes of segments and part types, and the properties."""
    t = star.terminology(spark, d)
    named = {x for pair in [*t.sub_class, *t.equivalent_class, *((a, b) for a, b in t.domain)] for x in pair} - {p for p, _ in t.domain}
    props = {p for p, _ in [*t.domain, *t.range]} | {x for pair in [*t.sub_property, *t.inverse] for x in pair}
    rows = [(c, "rdf:type", "owl:Class") for c in sorted(named)] + [(p, "rdf:type", "owl:ObjectProperty") for p in sorted(props)]
    rows += [(a, "rdfs:subClassOf", b) for a, b in t.sub_class] + [(a, "owl:equivalentClass", b) for a, b in t.equivalent_class] + [(a, "rdfs:domain", b) for a, b in t.domain]
    rows += [(a, "rdfs:range", b) for a, b in t.range] + [(a, "rdfs:subPropertyOf", b) for a, b in t.sub_property] + [(a, "owl:inverseOf", b) for a, b in t.inverse]
    rows += [(p, "rdf:type", "owl:TransitiveProperty") for p in t.transitive] + [(p, "rdf:type", "owl:SymmetricProperty") for p in t.symmetric] + [(p, "rdf:type", "owl:FunctionalProperty") for p in t.functional]
    return spark.createDataFrame(rows, "s string, p string, o string")


_SPELL = r"regexp_replace(c, '([a-z])([A-Z])', '\1 \2', 'g')"


@query("v_class_text", f"WITH {TYPES}, c AS (SELECT DISTINCT c FROM types) SELECT c AS node, {_SPELL} || CASE WHEN c LIKE '%Customer' THEN ' is a type of Customer.' ELSE ' is a type of Part.' END AS text FROM c WHERE c LIKE '%_Customer' OR c LIKE '%_Part' UNION ALL SELECT * FROM (VALUES ('Customer', 'Customer is a type of Party.'), ('Supplier', 'Supplier is a type of Party.'), ('Nation', 'Nation is a type of Place.'), ('Region', 'Region is a type of Place.'), ('Party', 'Party is a class in this ontology.'), ('Place', 'Place is a class in this ontology.'), ('Part', 'Part is a class in this ontology.'), ('Client', 'Client is equivalent to Customer.'), ('Order', 'Instances of Order can have Placed By and Supplied By relationships.')) v(node, text)")
def v_class_text(spark, d):
    return describe.class_text(schema(spark, d))


@query("v_property_text", "SELECT * FROM (VALUES ('inNation', 'In Nation is a relationship property. It is a sub-property of Located In.'), ('inRegion', 'In Region is a relationship property. It is a sub-property of Located In.'), ('orderedFrom', 'Ordered From is a relationship property. It is a sub-property of Trades With.'), ('tradesWith', 'Trades With is a relationship property. This property is symmetric (if A relates to B, then B relates to A).'), ('locatedIn', 'Located In is a relationship property. This property is transitive (it can form chains of relationships).'), ('placed', 'Placed is a relationship property. It is the inverse of the Placed By property.'), ('placedBy', 'Placed By is a relationship property. This property is functional (each entity can have at most one value). This property connects Order to Customer.'), ('suppliedBy', 'Supplied By is a relationship property.')) v(node, text)")
def v_property_text(spark, d):
    return describe.property_text(schema(spark, d))


@query("v_label", "SELECT 'http://x.org/o#customer_' || c_custkey AS node, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name[1]) || lower(c_name[2:]) WHEN c_custkey % 3 = 1 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) WHEN c_custkey BETWEEN 1000 AND 9999 THEN 'Customer' ELSE 'Customer' END AS label FROM customer")
def v_label(spark, d):
    c = _t(spark, d, "customer")
    node = F.concat(F.lit("http://x.org/o#customer_"), "c_custkey").alias("s")
    told = c.where("c_custkey % 3 = 0").select(node, F.lit("rdfs:label").alias("p"), F.col("c_name").alias("o"))
    other = c.where("c_custkey % 3 < 2").select(node, F.lit("schema:name").alias("p"), F.col("c_mktsegment").alias("o"))
    return describe.labels(told.unionByName(other), c.select(node.alias("node")))


@query("v_individuals", f"WITH {FACTS} SELECT split_part(x, '_', 1) AS kind, count(*) AS n FROM (SELECT s AS x FROM facts WHERE p IN ('inNation', 'placedBy') UNION SELECT o FROM facts WHERE p IN ('inNation', 'placedBy')) GROUP BY 1")
def v_individuals(spark, d):
    f = star.facts(spark, d, ("inNation", "placedBy"))
    kinds = spark.createDataFrame([("inNation", "rdf:type", "owl:ObjectProperty"), ("placedBy", "rdf:type", "owl:ObjectProperty")], "s string, p string, o string")
    return describe.individuals(f.unionByName(kinds)).groupBy(F.split_part("node", F.lit("_"), F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("v_restriction", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'that has some ''has brand'' relationship with an instance of ' || p_brand WHEN 1 THEN 'that only has ''has brand'' relationships with instances of ' || p_brand WHEN 2 THEN 'that has exactly ' || p_size || ' ''has brand'' relationship(s) with an instance of ' || p_brand END AS text FROM part")
def v_restriction(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["some", "only", "exactly", "self"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", describe.restriction_text(kind, F.lit("has brand"), F.col("p_brand"), F.col("p_size")).alias("text"))


# ---- abstraction ----------------------------------------------------------------------------------------------------
_TTL = """ttl AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS w, CASE p_partkey % 4 WHEN 0 THEN 'ns1:' || string_split(p_name, ' ')[1] || ' a owl:Class .' WHEN 1 THEN '<http://e.org/o#' || string_split(p_name, ' ')[1] || '> rdf:type owl:ObjectProperty .'
 WHEN 2 THEN repeat('ex:' || string_split(p_name, ' ')[1] || ' rdfs:label ', 6) ELSE string_split(p_name, ' ')[1] || ' owl:Class' END AS text FROM part)"""


def _ttl(spark, d) -> DataFrame:
    w, k = F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("ns1:"), w, F.lit(" a owl:Class ."))).when(k == 1, F.concat(F.lit("<http://e.org/o#"), w, F.lit("> rdf:type owl:ObjectProperty ."))).when(k == 2, F.repeat(F.concat(F.lit("ex:"), w, F.lit(" rdfs:label ")), 6)).otherwise(F.concat(w, F.lit(" owl:Class")))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), text.alias("text"))


@query("a_modes", f"WITH {_TTL} SELECT k, CASE k % 4 WHEN 1 THEN 'uri' WHEN 2 THEN 'prefix' ELSE 'unknown' END AS mode, CASE k % 4 WHEN 1 THEN 'http://e.org/o' WHEN 2 THEN 'ex' END AS target FROM ttl")
def a_modes(spark, d):
    return abstraction.modes(_ttl(spark, d), "k", "text")


@query("a_declared", f"WITH {_TTL} SELECT k, w AS term, CASE k % 4 WHEN 0 THEN 'class' ELSE 'object property' END AS category FROM ttl WHERE k % 4 < 2")
def a_declared(spark, d):
    return abstraction.declared(_ttl(spark, d), "k", "text")


@query("a_by_name", "WITH t AS (SELECT DISTINCT unnest([p_brand, string_split(p_name, ' ')[1], 'P' || p_partkey % 50, 'has' || p_size, 'Size']) AS term FROM part) SELECT term, CASE WHEN regexp_matches(term, '^[UPC][0-9]|[0-9]+$') THEN 'individual' ELSE 'object property' END AS category FROM t")
def a_by_name(spark, d):
    p = _t(spark, d, "part")
    t = p.select(F.explode(F.array("p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat(F.lit("P"), F.col("p_partkey") % 50), F.concat(F.lit("has"), "p_size"), F.lit("Size"))).alias("term")).distinct()
    return t.select("term", abstraction.category_by_name(F.col("term")).alias("category"))


@query("a_rewrite_names", f"WITH {_TTL} SELECT k, CASE k % 4 WHEN 1 THEN '<http://www.example.com/abstracted.owl#Class' || length(w) || '> rdf:type owl:ObjectProperty .' WHEN 2 THEN repeat('<http://www.example.com/abstracted.owl#Class' || length(w) || '> rdfs:label ', 6) ELSE text END AS text FROM ttl")
def a_rewrite_names(spark, d):
    w = F.split_part("p_name", F.lit(" "), F.lit(1))
    mapping = _t(spark, d, "part").select(w.alias("term"), F.concat(F.lit("Class"), F.length(w)).alias("abstract")).distinct()
    return abstraction.rewrite_names(_ttl(spark, d), mapping, "k", "text", "ex")


# ---- samples and answers --------------------------------------------------------------------------------------------
@query("m_split_sizes", "WITH g AS (SELECT o_orderstatus || '_' || o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS n_all, count(*) AS m, least(greatest(CAST(round(sum(n) * 0.05) AS BIGINT), count(*)), sum(n)) AS want FROM g), s AS (SELECT stratum, n, want - m AS more, greatest(0, round((n - 1) * (want - m)::DOUBLE / (n_all - m), 9)) AS x FROM g, t), r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, stratum) AS k, more - sum(floor(x)) OVER () AS rest FROM s) SELECT stratum, n, CAST(1 + floor(x) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r")
def m_split_sizes(spark, d):
    o = _t(spark, d, "orders")
    sizes = o.groupBy(F.concat_ws("_", "o_orderstatus", "o_orderpriority").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.quotas(sizes, round(o.count() * 0.05))


_Q = "conversations"


@query("l_quality", r"WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, lower(trim(coalesce(role, 'none'))) AS w, lower(trim(coalesce(text, 'none'))) AS g FROM conversations), x AS (SELECT *, list_distinct(regexp_extract_all(w, '\b(\w+)\b')) AS a, list_distinct(regexp_extract_all(g, '\b(\w+)\b')) AS b, len(list_filter(string_split_regex(t, '\s+'), lambda v: v <> '')) AS n FROM c) SELECT conv_id, turn, CASE WHEN t = '' THEN 0 WHEN contains(g, w) OR contains(w, g) THEN 1 WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) ELSE 0 END::DOUBLE AS correctness, CASE WHEN t = '' THEN 0 WHEN n > 50 THEN 0.6 WHEN n >= 20 THEN 1 WHEN n >= 10 THEN 0.8 ELSE 0.3 END::DOUBLE AS completeness, CASE WHEN t = '' THEN 0 ELSE 0.5 * (CASE WHEN regexp_matches(t, '(?i)ANSWER:\s*[^\n]+') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)REASONING:\s*[^\n]+') THEN 1 ELSE 0 END) END::DOUBLE AS structure_compliance, CASE WHEN t = '' THEN 0 ELSE round(least(1, 0.3 * len(list_filter(['•', '-', '*', '1.', '2.', '3.'], lambda v: contains(t, v))) + 0.2 * len(list_filter(['because', 'therefore', 'since', 'thus', 'shows', 'indicates'], lambda v: contains(lower(t), v)))), 9) END::DOUBLE AS reasoning_quality FROM x")
def l_quality(spark, d):
    c = _t(spark, d, _Q)
    marks = answers.quality(F.col("text"), F.col("role"), F.col("text"), F.lit("MC"))
    return c.select("conv_id", "turn", *(F.round(v, 9).alias(k) for k, v in marks.items()))


@query("l_eligible", "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)")
def l_eligible(spark, d):
    known = _t(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("conv_id"))
    return _t(spark, d, _Q).select("conv_id", "turn").join(known, "conv_id", "left_semi")


@query("l_model_stats", f"WITH {_CASES} SELECT model, count(*) AS responses, count(*) FILTER (score > 0.5) AS correct, round(count(*) FILTER (score > 0.5) * 100.0::DOUBLE / count(*), 6) AS accuracy FROM scored GROUP BY model")
def l_model_stats(spark, d):
    right = F.count(F.when(F.col("score") > 0.5, 1))
    return scored(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("responses"), right.alias("correct"), F.round(right * 100.0 / F.count(F.lit(1)), 6).alias("accuracy"))


@query("x_models", "SELECT c_custkey, 'm' || k AS model, CASE k WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS final_answer, CASE k WHEN 1 THEN c_name END AS response FROM customer CROSS JOIN (VALUES (0), (1), (2)) v(k)")
def x_models(spark, d):
    wide = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("m0_final_answer"), F.col("c_mktsegment").alias("m1_final_answer"), F.col("c_nationkey").alias("m2_final_answer"), F.col("c_name").alias("m1_response"))
    return answers.long_answers(wide, "c_custkey", ("final_answer", "response"))


@query("x_valid_entities", "SELECT c_custkey, list_aggregate(list_sort(['answer one', 'answer two', 'building', 'member', 'p' || c_custkey, 'ann_lee_1' || (100 + c_custkey % 900)]), 'string_agg', ',') AS entities FROM customer")
def x_valid_entities(spark, d):
    c = _t(spark, d, "customer")
    context = F.concat(F.lit("Member of "), F.lit("Building: "), F.lit("<http://x.org/o#P"), "c_custkey", F.lit("> ann_lee_1"), (100 + F.col("c_custkey") % 900).cast("string"))
    return c.select("c_custkey", F.array_join(answers.valid_entities(context, F.lit("answer one; answer two")), ",").alias("entities"))


@query("x_success", f"WITH {_CASES} SELECT id, score >= 0.7 AS accurate, (1 - score) <= 0.3 AS faithful FROM scored")
def x_success(spark, d):
    s = scored(spark, d)
    return s.select("id", answers.succeeded(F.col("score"), F.lit(0.7), F.lit(False)).alias("accurate"), answers.succeeded(1 - F.col("score"), F.lit(0.3), F.lit(True)).alias("faithful"))


@query("x_fuzzy_match", "SELECT 'PREFIX a: b PREFIX c: d PREFIX e: f SELECT ?x WHERE { <supplier_' || s_suppkey || '> <p> ?x } LIMIT' AS query, 'PREFIX a: b PREFIX c: d PREFIX e: f SELECT ?x WHERE { <supplier_' || s_suppkey || '> <p> ?x }' AS match FROM supplier WHERE s_suppkey % 2 = 0")
def x_fuzzy_match(spark, d):
    q = F.concat(F.lit("PREFIX a: b PREFIX c: d PREFIX e: f SELECT ?x WHERE { <supplier_"), "s_suppkey", F.lit("> <p> ?x }"))
    s = _t(spark, d, "supplier")
    asked = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(q, F.lit(" LIMIT"))).otherwise(F.concat(q, F.lit(" LIMIT 1 OFFSET 2"))).alias("query"))
    return answers.fuzzy_queries(asked, s.select(q.alias("query")))


@query("x_shortest_tag", "SELECT 'q' || c_custkey AS query, 'k' || c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'SS' END AS tag FROM customer UNION ALL SELECT 'r' || c_custkey, 'k' || c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'SS' END FROM customer")
def x_shortest_tag(spark, d):
    k = F.col("c_custkey")
    path = lambda *x: F.array(*map(F.lit, x))
    lists = F.when(k % 3 == 0, F.array(path("a", "b", "TAG:DHDH"), path("a", "b", "TAG:DH"), path("a", "TAG:D"))).when(k % 3 == 1, F.array(path("a", "b", "c", "TAG:T"), path("a", "b", "TAG:DSS"))).otherwise(F.array(path("a", "TAG:D")))
    rows = _t(spark, d, "customer").select(F.concat(F.lit("k"), k).alias("key"), lists.alias("explanations"), F.array(F.concat(F.lit("q"), k), F.concat(F.lit("r"), k)).alias("sparqlQueries"))
    return answers.shortest_tags(rows)


@query("x_rank_test", f"WITH {_CASES}, s AS (SELECT model, round(score, 9) AS v FROM scored), u AS (SELECT a.model AS a, b.model AS b, sum(CASE WHEN a.v > b.v THEN 1.0::DOUBLE WHEN a.v = b.v THEN 0.5 ELSE 0 END) AS u FROM s a JOIN s b ON a.model < b.model GROUP BY 1, 2), m AS (SELECT model, count(*)::DOUBLE AS n, avg(v) AS mean FROM s GROUP BY 1), t AS (SELECT a, b, sum(t * t * t - t) AS ties FROM (SELECT a, b, v, count(*)::DOUBLE AS t FROM u JOIN s ON s.model = a OR s.model = b GROUP BY 1, 2, 3) GROUP BY 1, 2), z AS (SELECT u.a, u.b, x.mean - y.mean AS diff, (greatest(u, x.n * y.n - u) - x.n * y.n / 2 - 0.5) / sqrt(x.n * y.n / 12 * ((x.n + y.n + 1) - ties / ((x.n + y.n) * (x.n + y.n - 1)))) AS z, x.n AS na, y.n AS nb FROM u JOIN t ON u.a = t.a AND u.b = t.b JOIN m x ON x.model = u.a JOIN m y ON y.model = u.b) SELECT a, b, round(diff, 9) AS mean_difference, CASE WHEN na <= 30 OR nb <= 30 THEN NULL WHEN z > 3.290526731 THEN '***' WHEN z > 2.575829304 THEN '**' WHEN z > 1.959963985 THEN '*' ELSE 'ns' END AS significance FROM z")
def x_rank_test(spark, d):
    found = answers.rank_test(scored(spark, d).select("model", F.round("score", 9).alias("score")))
    return found.select("a", "b", F.round("mean_difference", 9).alias("mean_difference"), "significance")


_TAGS = ["D", "H", "T", "S", "I", "R", "N", "M", "C", "U"]


@query("x_group_analysis", f"WITH {_CASES}, t AS (SELECT model, score, ['DHH', 'DIIRM', 'DDTT', 'DSSC', 'DR', 'DUNN'][id % 6 + 1] AS tag FROM scored), g AS (SELECT *, unnest(['D', 'H', 'T', 'S', 'I', 'R', 'N', 'M', 'C', 'U']) AS grp FROM t) SELECT model, grp, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM g WHERE contains(tag, grp) GROUP BY model, grp HAVING count(*) >= 3")
def x_group_analysis(spark, d):
    tag = F.element_at(F.array(*map(F.lit, ["DHH", "DIIRM", "DDTT", "DSSC", "DR", "DUNN"])), (F.col("id") % 6 + 1).cast("int"))
    g = scored(spark, d).withColumn("tag", tag).withColumn("grp", F.explode(F.array(*map(F.lit, _TAGS)))).where(F.col("tag").contains(F.col("grp")))
    return g.groupBy("model", "grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std")).where("n >= 3")


@query("x_case_assembly", f"WITH {_CASES} SELECT id, 'Task Type: ' || kind || chr(10) || 'Model: ' || model AS context, score >= 1 AS correct FROM scored")
def x_case_assembly(spark, d):
    return scored(spark, d).select("id", F.concat(F.lit("Task Type: "), "kind", F.lit("\nModel: "), "model").alias("context"), (F.col("score") >= 1).alias("correct"))


@query("l_strict_type", "SELECT p_partkey, CASE WHEN p_partkey % 8 < 4 THEN 'binary' ELSE 'multi choice' END AS kind FROM part")
def l_strict_type(spark, d):
    told = F.element_at(F.array(*map(F.lit, [" BIN", "Binary", "true/false", "True False ", "MC", "multi choice", "Multiple Choice", "\tmultichoice"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", answers.strict_answer_type(told).alias("kind"))


@query("l_completed", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS answered, count(DISTINCT o_orderstatus) = 3 AS complete FROM (SELECT o_custkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS o_orderstatus FROM orders) GROUP BY o_custkey")
def l_completed(spark, d):
    response = F.when(F.col("o_orderkey") % 4 > 0, F.lit("yes")).when(F.col("o_orderkey") % 8 == 0, F.lit(""))
    return answers.completed(_t(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("model"), response.alias("response")), "o_custkey", ["F", "O", "P"])


@query("l_essential", f"WITH {_CASES} SELECT id AS query_index, model AS model_display_name, CAST(NULL AS VARCHAR) AS final_answer_extracted, round(score, 9) AS quality_correctness, CAST(NULL AS VARCHAR) AS response_time_seconds, CAST(NULL AS VARCHAR) AS error_occurred FROM scored")
def l_essential(spark, d):
    return answers.essential(scored(spark, d).select(F.col("id").alias("query_index"), F.col("model").alias("model_display_name"), F.round("score", 9).alias("quality_correctness"), "conf"))


@query("x_percent", "SELECT o_orderstatus, printf('%.1f%%', 100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders)) AS share, printf('%+.1f%%', 100.0::DOUBLE * (count(*) FILTER (o_orderkey % 2 = 0) - count(*) FILTER (o_orderkey % 2 = 1)) / count(*)) AS difference FROM orders GROUP BY o_orderstatus")
def x_percent(spark, d):
    o = _t(spark, d, "orders")
    even, odd = (F.count(F.when(F.col("o_orderkey") % 2 == k, 1)) for k in (0, 1))
    n = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), (even - odd).alias("more"))
    of = lambda part, whole: F.lit(100.0) * part / whole
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("o_orderstatus", answers.percentage(of(F.col("n"), F.col("total"))).alias("share"), answers.percentage(of(F.col("more"), F.col("n")), signed=True).alias("difference"))


@query("v_phrases", """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Is customer of Individual' || n_nationkey || ', not Word nor ' ||
 CASE WHEN n_name LIKE 'UNITED %' THEN 'Word' || substr(n_name, 7) ELSE n_name END || 'S, in Class' || r_regionkey || '?' END AS text
 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def v_phrases(spark, d):
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    named = nation.select(F.col("n_name").alias("term"), F.concat(F.lit("Individual"), "n_nationkey").alias("abstract"))
    named = named.union(region.select("r_name", F.concat(F.lit("Class"), "r_regionkey"))).union(spark.createDataFrame([("UNITED", "Word")], "term string, abstract string"))
    text = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("Is customer of "), "n_name", F.lit(", not UNITED nor "), "n_name", F.lit("S, in "), "r_name", F.lit("?")))
    c = _t(spark, d, "customer").join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(region), F.col("r_regionkey") == F.col("n_regionkey"))
    return verbal.rewrite_phrases(c.select("c_custkey", text.alias("text")), named, "c_custkey", "text")
