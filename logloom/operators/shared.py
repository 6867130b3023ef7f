"""Steps written to the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one (as in tests) gets a temporary folder; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-"))
    return spark.sparkContext.getCheckpointDir()


_open = threading.local()


@contextmanager
def gathered() -> Iterator[list[DataFrame]]:
    """The frames that this thread writes by `written` meanwhile, for `discard` once what was made of them has been stored."""
    before, frames = getattr(_open, "frames", None), []
    _open.frames = frames
    try:
        yield frames
    finally:
        _open.frames = before


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there. The files go with `discard`, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/logloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    back = spark.read.schema(df.schema).parquet(path)
    back._logloom_path = path
    if getattr(_open, "frames", None) is not None:
        _open.frames.append(back)
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what `written` wrote for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_logloom_path", None)
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Have the driver look for frames that nothing holds any more: shuffle files go only then."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, for costly expressions over a scan that came in fewer; as it is where it came in more."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
