"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session names one; an own folder where it is unset and the master is local. A cluster
    without the setting is refused: a folder of the driver's machine would be another one on each executor."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{what}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back; a lost executor then costs one stage only."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `saved` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            target = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that nothing refers to any more, which else wait for the driver's next
    large garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
