"""Cutting lineage by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a temporary one, if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "cut", instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage.

    Committed files outlive any executor, and their exact sizes let adaptive execution pick joins.
    A former result of cut() that nothing else reads may be named; its files go."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if instead_of is not None:
        remove(instead_of)
    return out


def remove(df: DataFrame) -> None:
    """Delete the files of a result of cut()."""
    if path := getattr(df, "_cut_path", None):
        session = df.sparkSession
        folder = session._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)
