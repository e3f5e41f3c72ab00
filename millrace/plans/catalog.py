"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import audits, contracts, flows, geometry, inputs, panel, records, results, spatial, stores

_FAMILIES = (flows, spatial, geometry, panel, records, results, contracts, stores, audits, inputs)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _FAMILIES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _FAMILIES for k, v in m.ORACLE_SQL.items()}
