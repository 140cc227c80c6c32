"""Names of the queries and of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import extraction, quality, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**extraction.QUERIES, **relational.QUERIES, **quality.QUERIES}
ORACLES: dict[str, str] = {**extraction.ORACLES, **relational.ORACLES, **quality.ORACLES}
