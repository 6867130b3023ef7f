"""Readers of exported log files in the vendors' wire formats, all giving source, stream, ts_ms, raw, attributes."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import patterns as P

RECORD = "source string, stream string, ts_ms long, raw string, attributes map<string,string>"
ORDER = ("source", "stream", "ts_ms", "raw", "attributes")


def _files(spark: SparkSession, stream: bool):
    """Files that are there, or a stream of those that come."""
    return spark.readStream if stream else spark.read


def read_cloudwatch(spark: SparkSession, path: str, since: int | None = None, until: int | None = None, pattern: str | None = None, groups: list[str] | None = None, limit: int | None = None, stream: bool = False) -> DataFrame:
    """Exported events, one JSON object a line: logGroupName, logStreamName, timestamp, message.

    groups may end in one * (all groups with that prefix); a group without events gives nothing.
    """
    df = _files(spark, stream).schema("logGroupName string, logStreamName string, timestamp long, message string").json(path)
    if groups is not None:
        wanted = F.lit(False)
        for g in dict.fromkeys(groups):
            wanted = wanted | (F.col("logGroupName").startswith(g[:-1]) if g.endswith("*") else F.col("logGroupName") == g)
        df = df.where(wanted)
    if pattern is not None:
        df = df.where(F.contains("message", F.lit(pattern)))
    attributes = F.map_from_arrays(F.array(F.lit("logStreamName")), F.array("logStreamName"))
    out = df.select(F.lit("cloudwatch").alias("source"), F.col("logGroupName").alias("stream"), F.col("timestamp").alias("ts_ms"), F.col("message").alias("raw"), attributes.alias("attributes"))
    return bounded(out, since, until, limit)


def read_splunk(spark: SparkSession, path: str, ingest_ms: int, index: str = "main", stream: bool = False) -> DataFrame:
    """NDJSON of search results; a line that is not JSON is kept as raw text at ingest time."""
    parsed = F.from_json("value", "result struct<_raw:string,_time:string,source:string,host:string>")
    df = _files(spark, stream).text(path).where(F.trim("value") != "").withColumn("r", parsed["result"])
    seconds = F.unix_millis(F.try_to_timestamp("r._time"))
    ts = F.coalesce(F.floor(F.col("r._time").try_cast("double") * 1000).cast("long"), seconds, F.lit(ingest_ms))
    attributes = F.map_filter(F.map_from_arrays(F.array(F.lit("source"), F.lit("host")), F.array("r.source", "r.host")), lambda k, v: v.isNotNull())
    return df.select(F.lit("splunk").alias("source"), F.lit(index).alias("stream"), ts.alias("ts_ms"), F.coalesce("r._raw", "value").alias("raw"), F.coalesce(attributes, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("attributes"))


def read_loki(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A query-range answer: data.result[].stream (labels) and .values[] of (nanoseconds, line)."""
    df = _files(spark, stream).option("multiLine", True).schema("data struct<result:array<struct<stream:map<string,string>,values:array<array<string>>>>>").json(path)
    s = df.select(F.explode("data.result").alias("r")).select(F.col("r.stream").alias("labels"), F.explode("r.values").alias("v"))
    ns = F.get("v", F.lit(0)).cast("long")
    return s.select(F.lit("grafana").alias("source"), F.to_json("labels").alias("stream"), F.floor(ns / 1_000_000).cast("long").alias("ts_ms"), F.get("v", F.lit(1)).alias("raw"), F.col("labels").alias("attributes"))


def extract_email_text(raw):
    """Body after the first empty line, soft line breaks undone, first 4000 characters."""
    at = F.instr(raw, "\r\n\r\n")
    body = F.when(at > 0, F.substring(raw, at + 4, F.length(raw))).otherwise(raw)
    return F.substring(F.regexp_replace(F.regexp_replace(body, r"=\r?\n", ""), r"^\s+|\s+$", ""), 1, 4000)


def read_email(spark: SparkSession, path: str, since: int | None = None, stream: bool = False) -> DataFrame:
    """One file is one message; its time is the file's modification time."""
    df = _files(spark, stream).format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    raw = extract_email_text(F.decode("content", "UTF-8"))
    out = df.select(F.lit("email").alias("source"), F.lit("inbox").alias("stream"), F.unix_millis("modificationTime").alias("ts_ms"), raw.alias("raw"), F.map_from_arrays(F.array(F.lit("key")), F.array("path")).alias("attributes"))
    return bounded(out, since)


def bounded(records: DataFrame, since: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame:
    """Inclusive time range (None: open) and, where asked for, a number of rows, oldest first."""
    if since is not None:
        records = records.where(F.col("ts_ms") >= since)
    if until is not None:
        records = records.where(F.col("ts_ms") <= until)
    return records if limit is None else records.orderBy("ts_ms", "stream", "raw").limit(limit)


def all_sources(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): the records of all sources that can be read, and (source, error) of those that cannot.

    Each source is written to `folder` by a job of its own, side by side, so one that fails, before or while it is read, adds nothing and
    stops no other. What was written is read back.
    """

    def write(name: str) -> str | None:
        try:
            readers[name]().select(*ORDER).write.mode("overwrite").parquet(f"{folder}/{name}")
        except Exception as e:  # noqa: BLE001  one source must not stop the others
            return f"{type(e).__name__}: {str(e).splitlines()[0]}"
        return None

    with ThreadPoolExecutor(max(1, len(readers))) as pool:
        said = dict(zip(readers, pool.map(write, readers), strict=True))
    good = [f"{folder}/{n}" for n, e in said.items() if e is None]
    records = spark.read.schema(RECORD).parquet(*good) if good else spark.createDataFrame([], RECORD)
    return records, spark.createDataFrame([(n, e) for n, e in said.items() if e], "source string, error string")


def valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): records with a declared source, a time and a text, and the others."""
    good = F.coalesce(F.col("source").isin(*P.SOURCES) & F.col("ts_ms").isNotNull() & F.col("raw").isNotNull() & F.col("stream").isNotNull(), F.lit(False))
    return records.where(good), records.where(~good)
