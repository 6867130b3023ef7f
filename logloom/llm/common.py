"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators.shared import shared_root

#: A word is a run of characters other than the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder."""
    return shared_root(spark)


#: Shuffle files go when the statement that made them ends. What is written is read back from there, never from a shuffle.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the driver's JVM ends, or earlier through `discard`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/logloom-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    back = spark.read.schema(df.schema).parquet(path)
    back._logloom_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the files behind materialized frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_logloom_path", None)
        if path:
            spark = df.sparkSession
            hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def few(df: DataFrame, most: int) -> DataFrame:
    """df, for a broadcast where it has at most `most` rows; otherwise as it is, for a shuffle. df should be materialized."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def words(text: Column) -> Column:
    """Array of the words of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list[Column], value: Column, before: str, label: str = "ranged") -> DataFrame:
    """Add `before`: the sum of `value` over all rows earlier in the given total order.

    Range partitions are written once with their number, so both uses see the same bounds; totals per
    partition (one row each) are summed up and come back by a broadcast of that bounded table.
    """
    n = shuffle_width(df.sparkSession)
    ranged = materialize(
        df.withColumn("_value", value.cast("long")).repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()), label
    )
    totals = ranged.groupBy("_slice").agg(F.sum("_value").alias("_sum"))
    w = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inner", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
        .join(F.broadcast(offsets), "_slice")
        .withColumn(before, F.col("_inner") + F.col("_offset"))
        .drop("_slice", "_inner", "_offset", "_value")
    )


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
