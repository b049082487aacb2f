"""The queries of the alignment operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_align, queries_results, queries_scalars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = queries_scalars.QUERIES | queries_align.QUERIES | queries_results.QUERIES
ORACLES: dict[str, str] = queries_scalars.ORACLES | queries_align.ORACLES | queries_results.ORACLES
