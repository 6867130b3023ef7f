"""Clusters, baselines, correlation and entries over parsed logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import patterns as P
from logloom.functions.parsing import category, once
from logloom.functions.protocols import is_transaction_line
from logloom.operators.shared import written

ALPHA, MIN_WINDOW_MS = 0.3, 1000
EVIDENCE, EXCERPT = 10, 800


def unclaimed(records: DataFrame) -> DataFrame:
    """Records that are no lines of transactions: taken before `parse`, so the others are not parsed."""
    told = once(records, _claimed=F.coalesce(is_transaction_line(F.col("raw")), F.lit(False)))
    return told.where("not _claimed").drop("_claimed")


def classified(parsed: DataFrame, claimed: bool = True) -> DataFrame:
    """Lines with a category, which is added. Lines of transactions are for the transaction operators and are left out; claimed: there may be some."""
    apart = F.when(~F.coalesce(is_transaction_line(F.col("raw")), F.lit(False)), category()) if claimed else category()
    lines = once(parsed, category=apart)
    return lines.where(F.col("category").isNotNull())


def category_clusters(parsed: DataFrame, claimed: bool = True) -> DataFrame:
    """One row per (category, fingerprint): counts, span, sources and the first lines as evidence.

    Only the first EVIDENCE lines of a cluster are collected: they are ranked before the aggregation, and the
    counts come from a partial aggregation, so a hot cluster costs one row per task.
    """
    found = classified(parsed, claimed)
    keys = ["category", "fingerprint"]
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_logs"), F.min("ts_ms").alias("window_start"), F.max("ts_ms").alias("window_end"), F.array_sort(F.collect_set("source")).alias("sources"))
    return counts.select(F.concat_ws(":", *keys).alias("key"), *keys, "n_logs", F.size("sources").alias("n_sources"), "sources", "window_start", "window_end")


def with_evidence(parsed: DataFrame) -> DataFrame:
    """Clusters as anomaly records: the first EVIDENCE lines (time, then id), excerpts cut."""
    found = classified(parsed)
    w = Window.partitionBy("category", "fingerprint").orderBy("ts_ms", "log_id")
    first = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= EVIDENCE)
    line = F.struct(F.col("_r").alias("seq"), "log_id", "source", "stream", "ts_ms", F.substring("raw", 1, EXCERPT).alias("excerpt"))
    return first.groupBy("category", "fingerprint").agg(F.array_sort(F.collect_list(line)).alias("evidence"))


def correlate(parsed: DataFrame, window_ms: int = 300_000) -> DataFrame:
    """Groups of at least two lines that share an entity, within a window or across sources; largest first."""
    kinds = F.array(*[F.lit(k) for k in P.CORRELATION_ENTITIES])
    pairs = F.flatten(F.transform(kinds, lambda k: F.transform(F.coalesce(F.try_element_at("entities", k), F.array().cast("array<string>")), lambda v: F.concat(k, F.lit(":"), v))))
    keyed = parsed.select("log_id", "source", "ts_ms", F.explode(F.array_distinct(pairs)).alias("key"))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_logs"), F.min("ts_ms").alias("window_start"), F.max("ts_ms").alias("window_end"), F.count_distinct("source").alias("n_sources"))
    return groups.where((F.col("n_logs") >= 2) & ((F.col("window_end") - F.col("window_start") <= window_ms) | (F.col("n_sources") >= 2)))


def rates(parsed: DataFrame, window_ms: int) -> DataFrame:
    """Events per minute by fingerprint and tumbling window (windows with events only)."""
    per = max(window_ms, MIN_WINDOW_MS) / 60_000.0
    start = (F.floor(F.col("ts_ms") / window_ms) * window_ms).cast("long")
    return parsed.groupBy("fingerprint", start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.substring("message", 1, 500), F.struct("ts_ms", "log_id")).alias("sample")).withColumn("rate", F.col("n") / F.lit(per))


def baselines(rated: DataFrame) -> DataFrame:
    """EWMA rate and variance after the last window, with the last window's score against the state before it.

    The fold is sequential per fingerprint, over its windows in order (one entry per window).
    """
    state = F.struct(F.lit(0.0).alias("rate"), F.lit(0.0).alias("var"), F.lit(0).alias("k"), F.lit(0.0).alias("z"), F.lit(0.0).alias("prior"))

    def step(s, w):
        x = w["rate"]
        d = x - s["rate"]
        sd = F.when(s["var"] > 0, F.sqrt(s["var"])).otherwise(x * 0.25 + 1)
        first = s["k"] == 0
        return F.struct(
            F.when(first, x).otherwise(ALPHA * x + (1 - ALPHA) * s["rate"]).alias("rate"), F.when(first, 0.0).otherwise((1 - ALPHA) * (s["var"] + ALPHA * d * d)).alias("var"),
            (s["k"] + 1).alias("k"), F.when(first, 0.0).otherwise(d / sd).alias("z"), F.when(first, 0.0).otherwise(s["rate"]).alias("prior"),
        )

    series = rated.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("window_start", "rate", "n"))).alias("w"), F.sum("n").alias("occurrences"))
    folded = series.withColumn("s", F.aggregate("w", state, step)).withColumn("last", F.element_at("w", -1))
    return folded.select(
        "fingerprint", "occurrences", F.col("s.rate").alias("ewma_rate"), F.col("s.var").alias("ewma_variance"), F.col("last.rate").alias("observed_rate"), F.col("s.prior").alias("baseline_rate"),
        F.col("s.z").alias("z_score"), (F.col("s.k") == 1).alias("is_new"), F.col("last.n").alias("last_count"),
        (((F.col("s.k") == 1) & (F.col("last.n") >= 3)) | (F.col("s.z") >= 3)).alias("anomalous"),
    )


def entries(lines: DataFrame, order: list[str], starts=None, strict_adjacency: bool = False) -> DataFrame:
    """Join continuation lines to the entry above them: stream, entry, head (order columns), n_lines, raw.

    Entries are numbered within their stream. Lines are range-partitioned by stream and order and written once, so a
    hot stream spreads over many tasks; each counts its own starts and adds those of the slices before it. strict_adjacency ends
    an entry where another stream's line comes between; it needs one global order, so it is for small inputs.
    """
    begins = F.col("raw").rlike(P.STARTS_ENTRY) | (starts if starts is not None else F.lit(False))
    if strict_adjacency:
        begins = begins | ~F.lag("stream").over(Window.orderBy(*order)).eqNullSafe(F.col("stream"))
    slices = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flagged = lines.withColumn("_begins", F.coalesce(begins, F.lit(False)).cast("int")).repartitionByRange(slices, "stream", *order)
    ranged = written(flagged.withColumn("_slice", F.spark_partition_id()))
    counts = ranged.groupBy("stream", "_slice").agg(F.sum("_begins").alias("_n"), F.min_by("_begins", F.struct(*order)).alias("_first"))
    w = Window.partitionBy("stream").orderBy("_slice")  # a row per slice
    earlier = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A stream's first line begins an entry in any case.
    before = counts.select(F.col("stream").alias("_s"), F.col("_slice").alias("_k"), (earlier + 1 - F.first("_first").over(w)).alias("_before"))
    inner = F.sum("_begins").over(Window.partitionBy("_slice", "stream").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    counted = ranged.withColumn("_inner", inner)
    numbered = counted.join(before, counted["stream"].eqNullSafe(before["_s"]) & (F.col("_slice") == F.col("_k"))).withColumn("entry", F.col("_inner") + F.col("_before"))
    line = F.struct(*order, F.rtrim("raw").alias("_raw"))
    grouped = numbered.groupBy("stream", "entry").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    head = F.element_at("_lines", 1)
    return grouped.select("stream", "entry", *[head[c].alias(c) for c in order], F.size("_lines").alias("n_lines"), F.array_join(F.transform("_lines", lambda x: x["_raw"]), "\n").alias("raw"))
