"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_worker_path


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, which only a local master can share."""
    ensure_worker_path(spark)
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tessera_shared", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark._tessera_shared = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
    return path


def session_dir(spark: SparkSession) -> str:
    """The session's own folder within the shared one."""
    if not getattr(spark, "_tessera_session", None):
        spark._tessera_session = uuid.uuid4().hex
    return f"{shared_dir(spark)}/tessera/{spark._tessera_session}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of materialize() that no later plan reads."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all tables and files that the session's queries have left in the shared folder; results not yet written elsewhere need them."""
    _delete(spark, session_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
