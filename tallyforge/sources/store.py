"""Stored intermediate tables under the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without and then gets a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tallyforge-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read again: a stage boundary that outlives executors."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str = "table", **options: str) -> tuple[DataFrame, str]:
    """``stored``, and the path, for tables that are discarded before the process ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``stored_at`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def changed_at(spark: SparkSession, path: str) -> int:
    """When a table last changed, by its file system; 0 if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return 0
    return max([fs.getFileStatus(at).getModificationTime(), *(f.getModificationTime() for f in fs.listStatus(at))])
