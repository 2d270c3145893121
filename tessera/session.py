"""Session helpers shared by every layer of the engine."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, app: str = "tessera") -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed or shipped with --py-files."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in known if p]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's Parquet file or folder; only Spark's reader touches the path."""
    ensure_worker_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
