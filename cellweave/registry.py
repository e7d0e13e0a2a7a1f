"""All queries of the core library by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellweave import annotation, problems

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**annotation.QUERIES, **problems.QUERIES}
