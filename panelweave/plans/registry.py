"""Registry of the library's queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.plans import linkage, panels, sources

FLAGSHIP = "q01_asof_group_mean"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = linkage.QUERIES | panels.QUERIES | sources.QUERIES
ORACLE_SQL: dict[str, str] = linkage.ORACLE_SQL | panels.ORACLE_SQL | sources.ORACLE_SQL
