"""Reports on runs, reviews and messages, and hooks for a user's own scorer, reviewer and embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.protocols import INSTALLED, Protocol, events

STALE_MS = 600_000


def poll_rollup(parsed: DataFrame, anomalies: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Per source: lines parsed, anomalies found, transactions spawned and closed. Sources without some have zeros.

    anomalies: source. lifecycle: source, spawned, closed (booleans). Each input is aggregated before the join.
    """
    count = F.count(F.lit(1))
    a = parsed.groupBy("source").agg(count.alias("n_parsed"))
    b = anomalies.groupBy("source").agg(count.alias("n_anomalies"))
    c = lifecycle.groupBy("source").agg(F.count_if("spawned").alias("n_spawned"), F.count_if("closed").alias("n_closed"))
    numbers = ("n_parsed", "n_anomalies", "n_spawned", "n_closed")
    return a.join(b, "source", "full").join(c, "source", "full").select("source", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers])


def run_totals(runs: DataFrame, by: str) -> DataFrame:
    """Sums over runs with counts by source (map<string, long>, `by_source`) and `lifecycle`, per `by` and source, with the run's share."""
    each = runs.select(by, F.explode("by_source").alias("source", "n")).groupBy(by, "source").agg(F.sum("n").alias("n"))
    whole = runs.groupBy(by).agg(F.sum(F.aggregate(F.map_values("by_source"), F.lit(0).cast("long"), lambda s, x: s + x) + F.col("lifecycle")).alias("total"))
    return each.join(whole, by)


def open_runs(runs: DataFrame, now: int) -> DataFrame:
    """Unfinished runs that are not stale."""
    return runs.where(F.col("finished_at").isNull() & (F.col("started_at") >= now - STALE_MS))


def newest_runs(runs: DataFrame, limit: int, finished: bool) -> DataFrame:
    found = runs.where(F.col("finished_at").isNotNull() if finished else F.col("finished_at").isNull())
    return found.orderBy(F.desc("finished_at" if finished else "started_at"), "id").limit(limit)


def poller_stats(runs: DataFrame, now: int, recent_ms: int = 86_400_000) -> DataFrame:
    """One row: runs, recent ones, the last, mean and p95 of their time, and anomalies produced."""
    took = F.col("finished_at") - F.col("started_at")
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("started_at") >= now - recent_ms).alias("recent"), F.max("started_at").alias("last_ms"),
        F.avg(took).alias("mean_ms"), F.percentile(took, 0.95).alias("p95_ms"), F.sum("produced").alias("produced"),
    )


def review_scorecard(validations: DataFrame) -> DataFrame:
    """One row over validations (reviewed boolean, n_findings, n_discarded, failed boolean, result)."""
    admitted, discarded = F.sum("n_findings"), F.sum("n_discarded")
    return validations.agg(
        F.count_if("reviewed").alias("reviewed"), F.count_if(F.col("result") == "ai_suspected").alias("suspected"), discarded.alias("discarded"),
        F.count_if("failed").alias("failed"), admitted.alias("admitted"), F.when(admitted + discarded > 0, discarded / (admitted + discarded)).alias("discard_rate"),
    )


def validation_scorecard(validations: DataFrame, results: tuple[str, ...]) -> DataFrame:
    """Counts of results, reviewed, failed and suppressed per application, and in total (application null), in one pass."""
    named = [F.count_if(F.col("result") == r).alias(f"n_{r}") for r in results]
    return validations.rollup("application").agg(F.count(F.lit(1)).alias("n"), *named, F.count_if("reviewed").alias("reviewed"), F.sum("n_discarded").alias("rejected"), F.count_if("failed").alias("failed"), F.count_if("suppressed").alias("suppressed"))


def rule_tally(reviews: DataFrame, limit: int = 10) -> DataFrame:
    """The rules that reviews propose most (proposed_rules: array<string>)."""
    return reviews.select(F.explode("proposed_rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule").limit(limit)


def alerts(anomalies: DataFrame, channel: str = "dashboard") -> DataFrame:
    """A pending alert for each anomaly that is grave enough."""
    grave = anomalies.where(F.col("severity").isin("high", "critical"))
    return grave.select(F.concat(F.lit("alert-"), "anomaly_id").alias("alert_id"), "anomaly_id", F.lit(channel).alias("channel"), F.lit("pending").alias("status"))


def active_by_spawn(transactions: DataFrame, limit: int) -> DataFrame:
    """The transactions that still wait, longest-running first."""
    return transactions.where(F.col("status").isin("awaiting", "undecided")).orderBy("spawned_at", "corr_id").limit(limit)


def active_and_matching(transactions: DataFrame, keys: DataFrame) -> DataFrame:
    """Transactions that still wait, and those that a batch's keys name, each once."""
    active = transactions.where(F.col("status").isin("awaiting", "undecided"))
    return active.unionByName(transactions.join(keys.select("corr_id").distinct(), "corr_id", "left_semi")).dropDuplicates(["application", "corr_id"])


def fresh_entries(entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries that hold a line new to this batch. entries: log_ids (array). fresh: log_id."""
    touched = entries.withColumn("_log", F.explode("log_ids")).join(fresh.select(F.col("log_id").alias("_log")).distinct(), "_log", "left_semi")
    return entries.join(touched.select("stream", "entry").distinct(), ["stream", "entry"], "left_semi")


def message_view(lines: DataFrame, apps: tuple[Protocol, ...] = INSTALLED) -> DataFrame:
    """Type, own id, correlation id and code of each event line; the own id defaults to the correlation id."""
    return events(lines, apps).select("log_id", "application", "type", F.coalesce("own_id", "corr_id").alias("message_id"), "corr_id", "ack_code")


def classify_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Gold cases (case_id, corr_id, expected, known_gap) with the result of a replay: tp, fp, fn or tn, and gaps open or resolved.

    A result other than success counts as a finding; a case whose transaction has no result is a miss.
    """
    joined = cases.join(results.select("corr_id", "result"), "corr_id", "left")
    found, wanted = F.coalesce(F.col("result") != "success", F.lit(False)), F.col("expected") != "success"
    verdict = F.when(found & wanted, "tp").when(found, "fp").when(wanted, "fn").otherwise("tn")
    gap = F.when(F.col("known_gap"), F.when(found == wanted, "resolved").otherwise("open"))
    return joined.select("case_id", "corr_id", "expected", "result", verdict.alias("verdict"), gap.alias("gap"))


def gate(classified: DataFrame, floor: float = 1.0) -> DataFrame:
    """Precision and recall over all cases but known gaps, gaps by state, and whether both reach the floor."""
    gating = F.col("gap").isNull()
    n = {v: F.count_if(gating & (F.col("verdict") == v)) for v in ("tp", "fp", "fn")}
    precision = F.when(n["tp"] + n["fp"] > 0, n["tp"] / (n["tp"] + n["fp"])).otherwise(1.0)
    recall = F.when(n["tp"] + n["fn"] > 0, n["tp"] / (n["tp"] + n["fn"])).otherwise(1.0)
    out = classified.agg(precision.alias("precision"), recall.alias("recall"), F.count_if(F.col("gap") == "open").alias("gaps_open"), F.count_if(F.col("gap") == "resolved").alias("gaps_resolved"))
    return out.withColumn("passed", (F.col("precision") >= floor) & (F.col("recall") >= floor))


Batches = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def score_undecided(transactions: DataFrame, scorer: Batches) -> DataFrame:
    """Undecided transactions by a user's scorer (batches in, rows of corr_id, status, reason out); the others stay as they are."""
    scored = transactions.where("status = 'undecided'").mapInPandas(scorer, "corr_id string, status string, reason string")
    named = scored.where(F.col("status").isin("completed", "failed", "awaiting", "undecided")).dropDuplicates(["corr_id"]).select("corr_id", F.col("status").alias("_status"), "reason")
    out = transactions.join(named, "corr_id", "left")
    return out.withColumn("status", F.when(F.col("status") == "undecided", F.coalesce("_status", "status")).otherwise(F.col("status"))).drop("_status")


def review(transactions: DataFrame, reviewer: Batches, schema: str) -> DataFrame:
    """Claims by a user's reviewer, for `claims.admit`."""
    return transactions.mapInPandas(reviewer, schema)


def embed(texts: DataFrame, embedder: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """texts with `embedding` by a user's function over batches."""
    of: Column = F.pandas_udf(embedder, "array<float>")(text)
    return texts.withColumn("embedding", of)
