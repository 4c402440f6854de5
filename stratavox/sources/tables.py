"""Tables written between the steps of a job, in the folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[tuple[str, str], str] = {}


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a fresh local folder (tests). Any other master
    has executors that would not see such a folder, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset; on {master} it must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stratavox-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one; it is deleted as the application ends."""
    key = spark.sparkContext.applicationId, shared_dir(spark)
    if key not in _folders:
        _folders[key] = f"{key[1]}/stratavox-{key[0]}-{uuid.uuid4().hex}"
        target, fs = hadoop_path(spark, _folders[key])
        fs.mkdirs(target)
        fs.deleteOnExit(target)
    return _folders[key]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which ends its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
