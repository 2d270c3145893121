"""Every registered query of the engine's own operators, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, inference, models, more, tables

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [tables, inference, models, more, files]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-normalised values with grouped descriptives."""
    return tables.QUERIES["a1_normalised_descriptives"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
