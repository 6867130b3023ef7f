"""Batch assembly of transactions from events, their transitions and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.protocols import Protocol


def assemble(events: DataFrame, app: Protocol, now: int) -> DataFrame:
    """One row per (application, corr_id): phase times, latest code, status after the transition rule at `now`.

    Partial aggregates only; the phase set is the protocol's, so the pivot has a fixed width.
    """
    own = events.where(F.col("application") == app.id)
    phase = {p: F.min(F.when(F.col("type") == p, F.col("ts_ms"))).alias(f"ts_{p}") for p in app.phases}
    coded = F.when(F.col("ack_code").isNotNull() & (F.col("ack_code") != ""), F.struct("ts_ms", "log_id"))
    t = own.groupBy("application", "corr_id").agg(
        *phase.values(), F.min("ts_ms").alias("spawned_at"), F.max_by("ack_code", coded).alias("ack_code"), F.count_if(~app.success(F.col("ack_code"))).alias("n_failing"),
        F.min_by("source", F.struct("ts_ms", "log_id")).alias("source"), F.min_by("stream", F.struct("ts_ms", "log_id")).alias("log_group"),
    )
    return transition(t, app, now)


def missing_phases(app: Protocol) -> Column:
    return F.filter(F.array(*[F.when(F.col(f"ts_{p}").isNull(), F.lit(p)) for p in app.phases]), lambda p: p.isNotNull())


def transition(t: DataFrame, app: Protocol, now: int) -> DataFrame:
    """Status from phases and codes: a failing code decides, then completeness, then the two-clock timeout."""
    done = F.col(f"ts_{app.completing}").isNotNull()
    missing = missing_phases(app)
    last = F.greatest(*[F.coalesce(f"ts_{p}", F.lit(0)) for p in app.phases], F.col("spawned_at"))
    idle = (F.lit(now) - last > app.timeout_minutes * 60_000) & (F.lit(now) - F.coalesce(*(["first_seen_at"] if "first_seen_at" in t.columns else []), "spawned_at") > app.timeout_minutes * 60_000)
    failed = ~app.success(F.col("ack_code"))
    rule = F.when(failed, "failed").when(done & (F.size(missing) == 0), "completed").when(done, "undecided").otherwise("awaiting")
    status = F.when(rule.isin("awaiting", "undecided") & idle, "error").otherwise(rule)
    out = t.withColumn("status", status).withColumn("missing", missing).withColumn("last_activity", last)
    out = out.withColumn("active", F.col("status").isin("awaiting", "undecided"))
    return out.withColumn("waiting_for", F.when(F.col("active"), F.get("missing", F.lit(0)))).withColumn("closed_at", F.when(F.col("active"), F.lit(None)).when(F.col("status") == "error", F.col("last_activity") + app.timeout_minutes * 60_000).otherwise(F.col("last_activity")).cast("long"))


def counts_by_app(t: DataFrame) -> DataFrame:
    return t.groupBy("application").agg(F.count(F.lit(1)).alias("spawned"), F.count_if(F.size("missing") < F.lit(2)).alias("advanced"), F.count_if(~F.col("active")).alias("closed"))


def evidence_lines(lines: DataFrame, decisive: Column, limit: int = 25, cut: int = 200) -> DataFrame:
    """Per corr_id the first lines, decisive ones first."""
    w = Window.partitionBy("corr_id").orderBy(decisive.desc(), "ts_ms", "log_id")
    return lines.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).withColumn("excerpt", F.substring("raw", 1, cut))
