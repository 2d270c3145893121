"""Write the normalised observations of a corpus, one folder per class.

    python -m jobs.normalised --observations PATH --output PATH [--config FILE]

Each unit's (speaker's) values become z-scores by that unit's own mean and deviation over the rows that the configuration says
to fit on; the features named under semitones are also put on that scale. Statistics are always those of all rows read. The output
has the configuration's columns, {feature}_norm and {feature}_st:

    OUTPUT/class=NAME/part-*.parquet

Safe to run again: the same rows are written in place of those there. With classes given, only their folders are replaced
(the writer's dynamic mode), so that a class can be mended or added alone; without, the whole output is. Rows without a class go to the
folder "none". A unit with fewer than two values to fit on, or with equal ones, gets nulls; so do values that are missing or NaN. An
infinite value, as the logarithm of zero, is kept, and leaves its unit without a deviation: NaN, not null. How many rows were read and how many of their values are missing is counted by the scan that reads them, without another pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, observed
from tessera.functions.columns import semitones
from tessera.operators.describe import lobanov
from tessera.session import ensure_worker_path


def folder(cls: Column) -> Column:
    """The name of a class's folder; partition columns can't hold an empty name."""
    text = cls.cast("string")
    return F.coalesce(F.when(text != "", text), F.lit("none"))


def normalised(rows: DataFrame, features: dict[str, str], fit: str, reference: float, on_semitones: list[str]) -> DataFrame:
    """rows have a unit; features: feature -> the one whose mean and deviation it takes."""
    out = lobanov(rows.withColumn("_fit", F.coalesce(F.expr(fit), F.lit(False))), "unit", features, F.col("_fit")).drop("_fit")
    return out.withColumns({f"{x}_st": semitones(F.col(x), reference) for x in on_semitones})


def run(
    spark: SparkSession,
    observations: str,
    output: str,
    columns: dict[str, str],
    features: dict[str, str],
    fit: str = "true",
    semitones: list[str] | None = None,
    reference_hz: float = 100.0,
    classes: list[str] | None = None,
    nan_is_missing: bool = True,
) -> dict:
    """columns: output column -> expression over the table; unit and cls must be among them. Returns what was read and written.

    nan_is_missing: without it NaN is a value, as in SQL, and leaves its unit NaN alone."""
    ensure_worker_path(spark)
    cells = {k: F.expr(e) for k, e in columns.items()}
    number = lambda c: F.nanvl(c.cast("double"), F.lit(None)) if nan_is_missing else c.cast("double")
    rows = spark.read.parquet(observations).select(*[(number(c) if k in features else c).alias(k) for k, c in cells.items()])
    missing = {f"{x}_missing": F.count(F.when(F.col(x).isNull(), 1)) for x in ("unit", "cls", *features)}
    rows, read = observed(rows, rows_read=F.count(F.lit(1)), **missing)
    out = normalised(rows, features, fit, reference_hz, semitones or []).withColumn("class", folder(F.col("cls")))
    if classes is not None:
        out = out.where(F.col("class").isin(classes))
    out, wrote = observed(out, rows_written=F.count(F.lit(1)))
    mode = "static" if classes is None else "dynamic"
    # A class's rows are brought together in files of the advised size; a class that holds most rows is split among tasks.
    out.hint("rebalance", "class").write.partitionBy("class").mode("overwrite").option("partitionOverwriteMode", mode).parquet(output)
    missed = read()
    said = {**missed, **wrote()}
    log.info("read %d rows of %s (%s)", said["rows_read"], observations, ", ".join(f"{k}: {v}" for k, v in missed.items() if k != "rows_read"))
    log.info("wrote %d rows to %s (%s)", said["rows_written"], output, "all classes" if classes is None else ", ".join(classes))
    return said


if __name__ == "__main__":
    command_line(run, {"observations": "Parquet file or folder of observations", "output": "folder of the normalised rows"}, "normalised.yaml", __doc__)
