"""Triples stored so that patterns prune, and basic graph patterns over them.

A store is Parquet, one folder a bucket of predicates, rows sorted by predicate and subject: a pattern with a constant
predicate reads one bucket's folder, and within it the row groups whose statistics allow the constants. Any number of
predicates makes as many folders as buckets; a predicate that holds most rows spreads over files by subject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_SCHEMA = "g string, s string, p string, o string, bucket int"


def _bucket(p, buckets: int):
    return F.pmod(F.xxhash64(p), F.lit(buckets)).cast("int")


def store(triples: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes (g, s, p, o) under path, replacing what is there. Rows with a null subject, predicate or object are no triples."""
    rows = triples.select("g", "s", "p", "o").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").withColumn("bucket", _bucket(F.col("p"), buckets))
    ranged = rows.repartitionByRange("bucket", "p", "s").sortWithinPartitions("bucket", "p", "s")
    ranged.write.mode("overwrite").partitionBy("bucket").parquet(path)


def scan(spark: SparkSession, path: str, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(g, s, p, o) of a store's triples with the constants given; they prune folders and are pushed into the scan."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    if p is not None:
        home = spark.range(1).select(_bucket(F.lit(p), buckets)).first()[0]
        rows = rows.where(F.col("bucket") == home)
    for c, v in (("g", g), ("s", s), ("p", p), ("o", o)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return rows.select("g", "s", "p", "o")


def source(triples: DataFrame) -> Callable[..., DataFrame]:
    """The same scan over a table that isn't a store."""

    def run(**constants):
        rows = triples.select("g", "s", "p", "o")
        for c, v in constants.items():
            if v is not None:
                rows = rows.where(F.col(c) == v)
        return rows

    return run


def match(scan: Callable[..., DataFrame], patterns: list[tuple[str, str, str]], by_graph: bool = True) -> DataFrame:
    """The solutions of a basic graph pattern: one column a variable ('?x'), after `g`, distinct.

    Patterns are joined on the variables they share, those with most constants first; a variable used twice in one pattern
    must be the same there. All patterns hold within one graph, or over all of them if by_graph is False. Patterns that share
    no variable with the rest would be a cross join and raise.
    """
    if not patterns:
        raise ValueError("no pattern")
    free = lambda t: [x for x in t if x.startswith("?")]
    left = sorted(dict.fromkeys(patterns), key=lambda t: (len(free(t)), t))
    out, known = None, set()
    while left:
        at = next((k for k, t in enumerate(left) if not known or known & set(free(t))), None)
        if at is None:
            raise ValueError(f"{left[0]} shares no variable with the other patterns")
        t = left.pop(at)
        rows = scan(**{c: None if x.startswith("?") else x for c, x in zip("spo", t, strict=True)})
        first: dict[str, str] = {}
        for c, x in zip("spo", t, strict=True):
            if x.startswith("?"):
                if x in first:
                    rows = rows.where(F.col(c) == F.col(first[x]))
                first.setdefault(x, c)
        rows = rows.select(*(["g"] if by_graph else []), *(F.col(c).alias(x[1:]) for x, c in first.items())).distinct()
        shared = [*(["g"] if by_graph else []), *(x[1:] for x in first if x in known)]
        out = rows if out is None else out.join(rows, shared) if shared else rows
        known |= set(first)
        if not known and left and not by_graph:
            raise ValueError(f"{t} has no variable to join on")
    return out.distinct()
