"""Lineage cuts: intermediate results written to the folder that the cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one where that is unset and all runs in one process.

    Executors elsewhere would not see a folder of the driver's machine, so on a cluster an unset one raises.
    """
    found = spark.conf.get(KEY, None) or getattr(spark, "_quillspark_work", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark._quillspark_work = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below work_dir, removed when the driver's JVM ends."""
    path = f"{work_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete what new_path named, once nothing reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: survives lost executors, and later plans start here.

    The frame that comes back carries its path as ``cut_path``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that nothing refers to any more.

    One collection only lets go of what holds the plans; the second finds the shuffles. The cleaner
    works on its own, so each is given a moment before the next step writes.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)
