"""What the jobs share: their command line and their log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

from tessera.sources.tables import configuration
from tessera.sources.tables import observed as library_observed

log = logging.getLogger("tessera.jobs")


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """The library's observed counts; those of an empty input are zeros."""
    out, got = library_observed(df, **metrics)
    return out, lambda: {k: v or 0 for k, v in got().items()}


def command_line(run: Callable[..., dict], paths: dict[str, str], config: str, doc: str | None) -> None:
    """Read the paths and the configuration, run the job in a session of its own, print what it says as one JSON line."""
    parser = argparse.ArgumentParser(description=doc, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", default=str(Path(__file__).with_name(config)), help="a YAML file; by default the one beside the job")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = configuration(given.pop("config"))
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        print(json.dumps(run(spark, **given, **settings)))
    finally:
        spark.stop()
