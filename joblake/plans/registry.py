"""Registered queries: one per operator, each run on the driver's tables
through the bindings, each with its DuckDB oracle SQL where SQL can say it.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``.
Modules below add to both dicts with the ``register`` decorator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from joblake.plans.bindings import Tables, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(T: Tables) -> DataFrame`` under ``name``; ``sql`` is the
    oracle body (bindings are prefixed automatically)."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_bindings(sql)
        return fn

    return deco


MODULES = ["q_market", "q_browse", "q_listing", "q_dedup", "q_keywords", "q_vectors", "q_curation", "q_changes", "q_jobs", "q_more"]


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for m in MODULES:
        importlib.import_module(f"joblake.plans.{m}")
    from joblake.plans import q_oracles
    q_oracles.attach(ORACLE["classify_candidates"], ORACLE["resolve_merge_chains"], ORACLE["vector_search"])
