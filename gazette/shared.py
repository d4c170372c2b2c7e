"""Places in the folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode one of our own where it is unset.

    A cluster without the setting is an error: a machine-local folder would not be seen by others.
    """
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"{_KEY} must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gazette-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses. What is written there goes when the driver ends, if it ends in order."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append(path)
    return path


def _sweep() -> None:
    from pyspark import SparkContext

    if SparkContext._active_spark_context is None:
        return
    spark = SparkSession.getActiveSession()
    for path in _made if spark is not None else ():
        with contextlib.suppress(Exception):
            remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once as Parquet in the shared folder and read from there from now on."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
