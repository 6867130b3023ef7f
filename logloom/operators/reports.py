"""Answers about transactions by phase: what is complete, what was seen, and how one transaction stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.protocols import Protocol


def incomplete(events: DataFrame, app: Protocol) -> DataFrame:
    """(corr_id, missing): transactions whose first phase came and of which a later one did not. None for a protocol with one phase."""
    if len(app.phases) < 2:
        return events.select("corr_id", F.lit("").alias("missing")).where(F.lit(False))
    seen = events.where(F.col("application") == app.id).groupBy("corr_id").agg(F.collect_set("type").alias("seen"))
    missing = F.array_except(F.array(*[F.lit(p) for p in app.phases]), F.col("seen"))
    return seen.where(F.array_contains("seen", app.initial) & (F.size(missing) > 0)).select("corr_id", F.array_join(missing, ",").alias("missing"))


def by_phase(events: DataFrame, phases: tuple[str, ...], listed: int = 200) -> DataFrame:
    """(type, n, place, log_id): the messages of the asked phases in time, the first `listed` of each, with how many there are."""
    asked = events.where(F.col("type").isin(*phases))
    counts = asked.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("type").orderBy("ts_ms", "log_id"))
    return asked.withColumn("place", place).where(F.col("place") <= listed).select("type", "place", "log_id").join(counts, "type")


def status_of(events: DataFrame, app: Protocol) -> DataFrame:
    """(corr_id, phases, notes): each phase with its latest code, `+` or `-` for seen or not; notes on failed codes and on what is missing."""
    own = events.where(F.col("application") == app.id)
    latest = [F.max_by(F.coalesce("ack_code", F.lit("")), F.when(F.col("type") == p, F.struct("ts_ms", "log_id"))).alias(p) for p in app.phases]
    bad = F.array_sort(F.collect_set(F.when(~app.success(F.col("ack_code")), F.col("type"))))  # at most a value per phase
    t = own.groupBy("corr_id").agg(*latest, bad.alias("_bad"))
    parts = [F.concat(F.lit(f"{p}"), F.when(F.col(p).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(p)))) for p in app.phases]
    missing = F.concat_ws(",", *[F.when(F.col(p).isNull(), F.lit(p)) for p in app.phases])
    notes = F.concat_ws("; ", F.when(F.size("_bad") > 0, F.concat(F.lit("failed: "), F.array_join("_bad", ","))), F.when(missing != "", F.concat(F.lit("incomplete: "), missing)))
    return t.select("corr_id", F.concat_ws(" ", *parts).alias("phases"), notes.alias("notes"))
