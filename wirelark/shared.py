"""The folder that the driver and all executors share, and a folder of this run's own inside it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of each application, made on first use and removed when its JVM ends.
_runs: dict[str, str] = {}


def _removed_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def run_dir(spark: SparkSession) -> str:
    """This application's folder (a URI) under spark.checkpoint.dir. Where that is unset, one on this machine, in local mode only."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.gettempdir()
        base = base.rstrip("/") if "://" in base else f"file://{base.removeprefix('file:').rstrip('/')}"
        folder = f"{base}/wirelark-{app}-{uuid.uuid4().hex[:8]}"
        spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
        _removed_at_exit(spark, folder)
        _runs[app] = folder
    return _runs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of this run that nothing has used yet."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df through a table of this run, for what is read more than once and dear to make."""
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of this run ahead of its end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
