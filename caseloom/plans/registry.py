"""Every registered query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseloom.plans import catalog, entries, graph, intake, more, pages, records, rest, screening, text

MODULES = (catalog, screening, records, graph, text, more, pages, rest, intake, entries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
