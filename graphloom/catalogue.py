"""All queries of the engine and their SQL oracles, gathered from the operator modules."""

from __future__ import annotations

from .plans import more_queries, reason_queries, star_queries, text_queries


def _modules() -> list:
    return [star_queries, text_queries, more_queries, reason_queries]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}


def flagship(spark, sf_dir: str):
    return star_queries.r_closure_facts(spark, sf_dir)
