"""Shared plumbing: the cluster's shared folder, tables written there, shipping this package, schema helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SHIPPED: dict[str, bool] = {}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one where it is unset and the master is local.

    A cluster without the setting is refused: a folder of the driver's machine would be another one on each executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{what}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes a Parquet table in the shared folder and reads it back with the same schema.

    A lost executor then costs the tasks of one stage, never the stages behind this table.
    """
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: Rows of a few numbers each (some megabytes) that one task groups and joins sooner than a shuffle starts.
ONE_TASK = 200_000


def packed(df: DataFrame, rows: int, each: int = 10_000) -> DataFrame:
    """df in no more tasks than `rows`, counted rows that went into it, call for at `each` a task: a small table needs no
    task for every shuffle partition. As dealt where that many tasks are called for."""
    tasks = max(1, -(-rows // each))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def alone(df: DataFrame, rows: int, most: int = ONE_TASK) -> DataFrame:
    """df as one partition, whose groupings and joins with other such tables need no shuffle, if it has at most `most` rows
    (counted); larger tables as they are."""
    if rows > most:
        return df
    out = df.coalesce(1)
    out._scratch = getattr(df, "_scratch", None)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `saved` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            target = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and broadcasts of jobs that nothing refers to any more, which else wait for the
    driver's next large garbage collection, by default up to half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow whose tasks hand the memory they have freed back to the system: workers live on for other stages."""

    def run(batches):
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so Python workers import it wherever they run, and bounds
    the bytes of a batch of rows sent to them, unless the session has set that itself."""
    if spark.conf.get(_BATCH).rstrip("bB") == str(64 << 20):
        spark.conf.set(_BATCH, str(8 << 20))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="graphloom-ship-"), "graphloom_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED[app] = True


def fields(schema: T.StructType, *names: str) -> list[T.StructField]:
    return [schema[n] for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, for temporary columns beside unknown extra ones."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name
