"""Tables that a job writes for its own later steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []
_own_dir: str | None = None


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a temporary one where that is unset and Spark runs on this machine alone."""
    global _own_dir
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="skerry-")
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/skerry-{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later jobs neither compute it anew nor depend on executors that may be lost, and joins see its true size."""
    return stage_at(df, new_path(df.sparkSession, name), partition_by)


def stage_at(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    if (spark, path) in _staged:
        _staged.remove((spark, path))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_staged() -> None:
    for spark, path in list(_staged):
        with contextlib.suppress(Exception):  # the session may have ended, or the path be gone; the folder is scratch space
            drop_path(spark, path)
    if _own_dir:
        shutil.rmtree(_own_dir, ignore_errors=True)
