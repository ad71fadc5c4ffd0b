"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: set[str] = set()
#: Bytes of files that keep a core busy without further ado.
SPLIT_BYTES = 64 << 20
#: Rows of keys up to which a side of a join is broadcast.
FEW_ROWS = 500_000
#: Pairs that a task of a product makes.
TASK_PAIRS = 250_000


def folder(spark: SparkSession) -> str:
    """A subfolder of spark.checkpoint.dir, or of the context's checkpoint folder. Only a local master may go without either: its
    executors see the same disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (known := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = known.get()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base}/loom-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_remove, spark, own)
    return own


def _remove(spark: SparkSession, own: str) -> None:
    context, jvm = spark.sparkContext._jsc, spark.sparkContext._jvm
    if context is not None and jvm is not None and not context.sc().isStopped():
        path = jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a written table: it outlives executors, and later plans begin at it."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, read into every task by joins if it has few rows."""
    most = FEW_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def product_tasks(spark: SparkSession, rows: int, times: int) -> int:
    """How many tasks a product of so many rows takes. Small rows with many partners need that said: by their size they'd be one."""
    return max(spark.sparkContext.defaultParallelism, -(-rows * times // TASK_PAIRS))


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if it is so small that files alone would keep most of them idle; larger ones stay as they
    are. Rows are the same."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df
