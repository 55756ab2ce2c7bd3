"""Named queries over the driver tables: one per operator group of SURVEY §2.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the result is exact,
``ORACLE[name]`` is the same query in DuckDB SQL over the same parquet tables.
Queries are registered by the modules in ``casekit.plans.q_*``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casekit.plans.features import case_features
from casekit.sources.cases import case_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_table(spark, sf_dir)


def feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_features(case_table(spark, sf_dir))


def load_all() -> None:
    # importing registers the queries
    from casekit.plans import q_analytics, q_features, q_prep, q_evaluate, q_models, q_neighbours  # noqa: F401
