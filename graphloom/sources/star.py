"""The star schema read as a knowledge graph: assertional facts and types as DataFrames, and a fixed terminology.

Every table is read with only the columns its facts need; unions stay lazy, so a query over one predicate reads one
table (the predicate is a literal, and the optimiser drops branches whose filter is false).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import Terminology


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _node(kind: str, col: str) -> F.Column:
    return F.concat(F.lit(f"{kind}_"), F.col(col).cast("string"))


def _edge(df: DataFrame, s: tuple[str, str], p: str, o: tuple[str, str]) -> DataFrame:
    return df.select(_node(*s).alias("s"), F.lit(p).alias("p"), _node(*o).alias("o"))


def facts(spark: SparkSession, d: str, predicates: tuple[str, ...] = ("inRegion", "inNation", "placedBy", "hasPart", "suppliedBy")) -> DataFrame:
    """Distinct asserted facts (s, p, o) of the named predicates."""
    parts = []
    if "inRegion" in predicates:
        parts.append(_edge(_table(spark, d, "nation"), ("nation", "n_nationkey"), "inRegion", ("region", "n_regionkey")))
    if "inNation" in predicates:
        parts.append(_edge(_table(spark, d, "customer"), ("customer", "c_custkey"), "inNation", ("nation", "c_nationkey")))
        parts.append(_edge(_table(spark, d, "supplier"), ("supplier", "s_suppkey"), "inNation", ("nation", "s_nationkey")))
    if "placedBy" in predicates:
        parts.append(_edge(_table(spark, d, "orders"), ("order", "o_orderkey"), "placedBy", ("customer", "o_custkey")))
    if "hasPart" in predicates:
        parts.append(_edge(_table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct(), ("order", "l_orderkey"), "hasPart", ("part", "l_partkey")))
    if "suppliedBy" in predicates:
        parts.append(_edge(_table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct(), ("order", "l_orderkey"), "suppliedBy", ("supplier", "l_suppkey")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def types(spark: SparkSession, d: str) -> DataFrame:
    """Asserted types (i, c)."""
    word = lambda c: F.regexp_replace(F.initcap(F.lower(F.col(c))), "[^A-Za-z0-9]", "")
    c = _table(spark, d, "customer").select(_node("customer", "c_custkey").alias("i"), F.concat(word("c_mktsegment"), F.lit("Customer")).alias("c"))
    p = _table(spark, d, "part").select(_node("part", "p_partkey").alias("i"), F.concat(word("p_type"), F.lit("Part")).alias("c"))
    o = _table(spark, d, "orders").select(_node("order", "o_orderkey").alias("i"), F.lit("Order").alias("c"))
    s = _table(spark, d, "supplier").select(_node("supplier", "s_suppkey").alias("i"), F.lit("Supplier").alias("c"))
    return c.unionByName(p).unionByName(o).unionByName(s)


def terminology(spark: SparkSession | None = None, d: str | None = None) -> Terminology:
    """The fixed terminology; with tables at hand also one subclass a market segment and part type (bounded enumerations)."""
    t = Terminology(
        sub_property=[("inNation", "locatedIn"), ("inRegion", "locatedIn"), ("orderedFrom", "tradesWith")],
        inverse=[("placed", "placedBy")],
        symmetric=["tradesWith"],
        transitive=["locatedIn"],
        functional=["placedBy"],
        chains=[("placedBy", "inNation", "orderedFrom")],
        domain=[("placedBy", "Order"), ("suppliedBy", "Order")],
        range=[("placedBy", "Customer")],
        sub_class=[("Customer", "Party"), ("Supplier", "Party"), ("Nation", "Place"), ("Region", "Place")],
        equivalent_class=[("Client", "Customer")],
        unions=[("Place", ["Nation", "Region"])],
        disjoint=[("Customer", "Part")],
        some=[("hasPart", "Part", "GoodsOrder")],
    )
    if spark is not None:
        kinds = [r.c for r in types(spark, d).select("c").where("c IS NOT NULL").distinct().limit(10_001).collect()]
        if len(kinds) > 10_000:
            raise ValueError("more than 10,000 classes: not an enumeration of segments and part types")
        t.sub_class += [(k, base) for k in sorted(kinds) for base in ("Customer", "Part") if k.endswith(base) and k != base]
    return t
