"""All registered queries outside the corpus package: name -> query over a folder of tables, and the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bidscope.sources.domain import Tables

_MODULES = ("detector_queries", "indicator_queries", "market_queries", "graph_queries", "other_queries", "assessment_queries", "panel_queries", "ingest_queries", "profile_queries", "follow_queries", "specification_queries", "matching_queries", "model_queries", "search_queries", "feature_queries", "report_queries", "extraction_queries", "name_queries")


def _modules():
    return [importlib.import_module(f"bidscope.plans.{m}") for m in _MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    bound = lambda f: lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return {name: bound(f) for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors, the risk index and the rollup of flagged tenders."""
    return queries()["r1_flagged_rollup"](spark, sf_dir)
