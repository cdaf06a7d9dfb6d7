"""The registered queries of the analytics operators and the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteward.plans import contracts, correlation, exact, fieldwork, handoff, interface, lineage, nested, network, polygons, relaxation, reviews, skyline, stage1, stage2, stage3, stage4, universe
from siteward.streaming import windows

MODULES = (stage1, stage2, stage3, stage4, reviews, handoff, interface, universe, fieldwork, network, correlation, nested, polygons, exact, skyline, relaxation, contracts, lineage, windows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
