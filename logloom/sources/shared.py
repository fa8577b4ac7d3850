"""Tables between the steps of an operator, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and the master is local, as in tests. A cluster without it is refused."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    return "/tmp/logloom-checkpoint"


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which clear() deletes."""
    path = f"{shared_dir(spark)}/logloom-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table (zstd: lines take a fifth of Spark's default) in the shared folder: what follows neither computes it again nor loses it with an executor."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what this process has written; call it when no result that rests on it is needed."""
    conf = spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
