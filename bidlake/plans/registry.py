"""All queries of the library outside the corpus subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bidlake.plans import q_enrich, q_feed, q_lots, q_match, q_runs, q_sources, q_terms, q_texts

MODULES = (q_match, q_lots, q_feed, q_terms, q_runs, q_sources, q_enrich, q_texts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
