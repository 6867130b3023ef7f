"""Validation rules over assembled transactions, their scorecard and label metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import patterns as P
from logloom.functions.protocols import Protocol


def severity_rank(severity: Column) -> Column:
    """0 for info to 4 for critical; -1 for null or unknown."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in P.SEVERITIES]), severity).cast("int"), F.lit(0)) - 1


def meets(severity: Column, threshold: str = "high") -> Column:
    return severity_rank(severity) >= P.SEVERITIES.index(threshold)


def worst(severities: Column) -> Column:
    """Highest severity of an array, null if empty."""
    return F.aggregate(severities, F.lit(None).cast("string"), lambda a, s: F.when(a.isNull() | (severity_rank(s) > severity_rank(a)), s).otherwise(a))


def _minutes(ms: Column) -> Column:
    return F.floor(ms / 60_000 + 0.5).cast("long")


def derive_outcome(t: DataFrame, app: Protocol) -> DataFrame:
    """Outcome read from the events alone: any failing code, else the completing phase, else unknown."""
    seen = F.filter(F.array(*[F.when(F.col(f"ts_{p}").isNotNull(), F.lit(p)) for p in app.phases]), lambda p: p.isNotNull())
    outcome = F.when(F.col("n_failing") > 0, "failed").when(F.col(f"ts_{app.completing}").isNotNull(), "completed").otherwise("unknown")
    return t.withColumn("phases_seen", seen).withColumn("derived", outcome)


def validate(t: DataFrame, app: Protocol, now: int, window_start: int = 0) -> DataFrame:
    """Rules in order; t: an assembled and derived transaction with `actual_severity` and `quality` (array of severities)."""
    anchor, done = F.col(f"ts_{app.sla_from}"), F.col(f"ts_{app.completing}")
    latency = F.when(anchor.isNotNull(), F.when(done.isNotNull(), done - anchor).when(F.col("active"), F.lit(now) - anchor))
    budget = app.sla_minutes * 60_000
    breached = F.coalesce(latency > budget, F.lit(False))
    t = t.withColumn("response_latency_ms", latency).withColumn("sla_breached", breached)
    expected = F.when(F.col("status") == "failed", "high").when(F.col("status") == "error", "medium")
    actual, completed = F.col("actual_severity"), F.col("status") == "completed"
    covered = F.lit(window_start) <= F.col("spawned_at")
    order = F.array(*[F.lit(p) for p in app.phases])
    last_seen = F.array_position(order, F.element_at("phases_seen", -1)).cast("int")
    gaps = F.array_except(F.slice(order, F.lit(1), F.greatest(last_seen - 1, F.lit(0))), F.col("phases_seen"))
    stuck = anchor.isNull() & (F.lit(now) - F.col("last_activity") > budget)
    active_delta = [F.when(breached, "overdue").when(stuck, "stuck")]
    closed_delta = [
        F.when(expected.isNotNull() & actual.isNull(), F.concat(F.lit("missing anomaly: "), expected)).when(expected.isNull() & actual.isNotNull(), F.concat(F.lit("unexpected anomaly: "), actual)).when(expected != actual, F.concat(F.lit("wrong level: "), actual)),
        F.when(completed & (F.size("missing") > 0), F.concat(F.lit("missing phases: "), F.array_join("missing", ","))),
        F.when(completed & breached, F.concat(F.lit("SLA breach: "), _minutes(latency))),
        F.when((F.col("derived") == "failed") & completed, "status mismatch: failed").when((F.col("derived") == "completed") & F.col("status").isin("failed", "error"), "status mismatch: completed"),
        F.when(covered & completed & F.array_contains("phases_seen", app.initial) & ~F.array_contains("phases_seen", app.completing), "unverified completion"),
        F.when(covered & completed & (F.size("phases_seen") > 0) & (F.size(gaps) > 0), F.concat(F.lit("incomplete evidence: "), F.array_join(gaps, ","))),
    ]
    keep = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    t = t.withColumn("delta", F.when(F.col("active"), keep(active_delta)).otherwise(keep(closed_delta)))
    top = F.when(completed, worst(F.coalesce("quality", F.array().cast("array<string>"))))
    result = F.when(F.col("active"), "pending").when(F.size("delta") > 0, "failure").when(completed & meets(top, app.issue_severity), "completed_with_issues").otherwise("success")
    return t.withColumn("max_quality", top).withColumn("result", result).withColumn("sla_breached", F.when(F.col("active"), breached | stuck).otherwise(breached))


def order_violations(t: DataFrame, app: Protocol) -> DataFrame:
    """Neighbouring present phases whose first times decrease: one row per violation."""
    present = F.filter(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"ts_{p}").alias("ts")) for p in app.phases]), lambda x: x["ts"].isNotNull())
    pairs = F.filter(F.zip_with(F.slice(present, 1, F.greatest(F.size(present) - 1, F.lit(0))), F.slice(present, 2, F.greatest(F.size(present) - 1, F.lit(0))), lambda a, b: F.struct(a["phase"].alias("earlier"), b["phase"].alias("later"), (b["ts"] < a["ts"]).alias("bad"))), lambda z: z["bad"])
    return t.withColumn("_p", present).select("corr_id", F.explode(pairs).alias("v")).select("corr_id", "v.earlier", "v.later")


def duplicate_followups(events: DataFrame, app: Protocol) -> DataFrame:
    """(corr_id, type, n): follow-ups with more than one distinct own id."""
    n = F.count_distinct("own_id")
    return events.where(F.col("type").isin(*app.phases[1:]) & F.col("own_id").isNotNull()).groupBy("corr_id", "type").agg(n.alias("n")).where("n > 1")


def scorecard(validated: DataFrame) -> DataFrame:
    """Result counts per application and in total (application null)."""
    results = ("success", "failure", "completed_with_issues", "pending", "ai_suspected")
    return validated.rollup("application").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("result") == r).alias(r) for r in results], F.count_if("sla_breached").alias("sla_breached"), F.count_if(F.size("delta") > 0).alias("with_delta"), F.round(F.avg("response_latency_ms"), 4).alias("mean_latency_ms"))


def metrics(classified: DataFrame, *groups: str) -> DataFrame:
    """Confusion counts and rates overall and per group column, in one pass; classified: expected, flagged (booleans).

    Precision and recall are 1 on empty sides, f1 is 0 if both are 0, accuracy is 1 without rows.
    """
    e, f = F.col("expected"), F.col("flagged")
    counts = [F.count_if(e & f).alias("tp"), F.count_if(~e & ~f).alias("tn"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn")]
    if groups:
        keys = [F.col(g).cast("string").alias(g) for g in groups]
        sets = classified.select("expected", "flagged", *keys).groupingSets([[], *[[g] for g in groups]], *groups)
        # A bit of the grouping id is set where that column does not take part.
        every = (1 << len(groups)) - 1
        place = {g: every - (1 << (len(groups) - 1 - k)) for k, g in enumerate(groups)}
        out = sets.agg(*counts, F.grouping_id().alias("_set"))
        by, value = F.when(F.col("_set") == every, "all"), F.when(F.col("_set") == every, "all")
        for g, bits in place.items():
            by, value = by.when(F.col("_set") == bits, g), value.when(F.col("_set") == bits, F.col(g))
        out = out.select(by.alias("by"), value.alias("value"), "tp", "tn", "fp", "fn")
        if classified.isEmpty():
            out = classified.agg(*counts).select(F.lit("all").alias("by"), F.lit("all").alias("value"), "tp", "tn", "fp", "fn")
    else:
        out = classified.agg(*counts).select(F.lit("all").alias("by"), F.lit("all").alias("value"), "tp", "tn", "fp", "fn")
    rate = lambda a, b: F.when(b == 0, 1.0).otherwise(a / F.nullif(b, F.lit(0)))
    tp, total = F.col("tp"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    out = out.withColumn("precision", rate(tp, tp + F.col("fp"))).withColumn("recall", rate(tp, tp + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    out = out.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both)).withColumn("accuracy", rate(tp + F.col("tn"), total))
    return out.select("by", "value", "tp", "tn", "fp", "fn", "precision", "recall", "f1", "accuracy")


def gate(m: DataFrame) -> DataFrame:
    """One row: no false positives and no false negatives overall."""
    return m.where(F.col("by") == "all").select(((F.col("fp") == 0) & (F.col("fn") == 0)).alias("passed"))


def residual(validated: DataFrame) -> DataFrame:
    """Closed, clean, completed, but with nothing in the logs that proves the outcome; with the reason."""
    open_ = (~F.col("active")) & (F.size("delta") == 0) & (F.col("result") == "success") & (F.col("status") == "completed")
    why = F.when(F.col("derived") == "unknown", "outcome unproven").when(F.col("ack_code").isNull(), "no code recorded")
    return validated.where(open_).withColumn("reason", why).where(F.col("reason").isNotNull())


def record_outcome(flag: Column, status: Column) -> Column:
    """completed, failed or unknown from a system of record's flag or status word."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(F.coalesce(flag, F.lit(False)) | s.rlike(P.jvm(P.RECORD_DONE)), "completed").when(F.coalesce(~flag, F.lit(False)) | s.rlike(P.jvm(P.RECORD_FAILED)), "failed").otherwise("unknown")
