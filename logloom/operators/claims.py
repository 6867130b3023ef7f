"""Admission of reviewers' claims: every cited line must exist and every predicate must hold on it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import patterns as P
from logloom.functions.parsing import slug

MAX_CLAIMS, MAX_PREDICATES, MAX_PATTERN, MAX_SUBJECT, VACUOUS = 3, 10, 200, 4000, 14


@F.pandas_udf(T.BooleanType())
def _matches(subject: pd.Series, pattern: pd.Series) -> pd.Series:
    """Search by a claim's own pattern; one that does not compile proves nothing."""

    def one(s, p):
        try:
            return bool(re.search(p, s, re.I))
        except (re.error, TypeError):
            return False

    return pd.Series([one(s, p) for s, p in zip(subject, pattern, strict=True)], dtype=bool)


def _holds(op: Column, subject: Column, value: Column) -> Column:
    low_s, low_v = F.lower(subject), F.lower(value)
    a, b = subject.try_cast("double"), value.try_cast("double")
    known = subject.isNotNull() & (value != "")
    test = (
        F.when(op == "lt", a < b).when(op == "gt", a > b).when(op == "contains", F.contains(low_s, low_v))
        .when(op == "not_contains", ~F.contains(low_s, low_v)).when(op == "equals", subject == value)
    )
    return F.coalesce(known & test, F.lit(False))


def admit(claims: DataFrame, lines: DataFrame, patterns: bool = True) -> DataFrame:
    """Claims with `reason` (null: admitted), normalised severity and kind.

    claims: claim_id, corr_id, seq, title, kind, severity, evidence (array<string>), predicates
    (array<struct<log_id, field, op, value>>). lines: corr_id, log_id, raw, message, level, stream, source, ts_ms.
    """
    n = F.row_number().over(Window.partitionBy("corr_id").orderBy("seq", "claim_id"))
    c = claims.withColumn("_n", n)
    cited = c.select("claim_id", "corr_id", F.explode("evidence").alias("log_id")).distinct()
    unknown = cited.join(lines.select("corr_id", "log_id"), ["corr_id", "log_id"], "left_anti").groupBy("claim_id").agg(F.min("log_id").alias("_unknown"))
    preds = c.select("claim_id", "corr_id", "evidence", F.explode("predicates").alias("p")).select("claim_id", "corr_id", "evidence", "p.*")
    subject = F.substring(F.coalesce(*[F.when(F.col("field") == f, F.col(x).cast("string")) for f, x in (("raw", "raw"), ("message", "message"), ("level", "level"), ("stream", "stream"), ("source", "source"), ("timestamp", "ts_ms"))]), 1, MAX_SUBJECT)
    cites, op, value = F.array_contains("evidence", F.col("log_id")), F.col("op"), F.col("value")
    on_line = lambda p: p.join(lines, ["corr_id", "log_id"], "left")
    tested = on_line(preds.where(~F.coalesce(op == "matches", F.lit(False)))).select("claim_id", (cites & _holds(op, subject, value)).alias("_ok"))
    # Only claims' own patterns go through Python, and only those of a bounded length.
    own = on_line(preds.where(op == "matches"))
    if patterns:
        usable = subject.isNotNull() & (value != "") & (F.length(value) <= MAX_PATTERN) & cites
        fits = own.withColumn("_usable", F.coalesce(usable, F.lit(False)))
        tested = tested.union(fits.where("not _usable").select("claim_id", F.lit(False))).union(fits.where("_usable").select("claim_id", _matches(subject, value)))
    else:
        tested = tested.union(own.select("claim_id", F.lit(False)))
    verdict = tested.groupBy("claim_id").agg(F.bool_and("_ok").alias("_all_hold"))
    low = lambda p: F.lower(F.coalesce(p["value"], F.lit("")))
    positive = F.exists("predicates", lambda p: p["op"] != "not_contains")
    member = F.forall("predicates", lambda p: F.contains(low(p), F.lower("corr_id")) & (F.length(F.regexp_replace(F.replace(low(p), F.lower("corr_id"), F.lit("")), "[^a-z0-9]", "")) <= VACUOUS))
    shapes = F.transform("predicates", lambda p: F.concat_ws("|", p["field"], p["op"], low(p)))
    reason = (
        F.when(F.col("_n") > MAX_CLAIMS, "too many claims").when(F.trim(F.coalesce("title", F.lit(""))) == "", "no title").when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "no evidence")
        .when(F.col("_unknown").isNotNull(), "unknown log").when(F.coalesce(F.size("predicates"), F.lit(0)) < 1, "no predicate").when(F.size("predicates") > MAX_PREDICATES, "too many predicates")
        .when(~positive, "no positive evidence").when(member, "vacuous").when(F.size(F.array_distinct(shapes)) < F.size("predicates"), "co-occurrence only")
        .when(~F.coalesce("_all_hold", F.lit(False)), "predicate failed")
    )
    severity = F.when(F.col("severity").isin(*P.SEVERITIES), F.col("severity")).otherwise("medium")
    out = c.join(unknown, "claim_id", "left").join(verdict, "claim_id", "left")
    return out.withColumn("reason", reason).withColumn("severity", severity).withColumn("kind", slug(F.coalesce("kind", F.lit("")))).drop("_n", "_unknown", "_all_hold")


def apply_review(validated: DataFrame, admitted: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Relabel clean successes with admitted findings as ai_suspected; deltas stay. reviewed: corr_id of finished reviews."""
    findings = admitted.where(F.col("reason").isNull()).groupBy("corr_id").agg(F.count(F.lit(1)).alias("n_findings"))
    out = validated.join(findings, "corr_id", "left").join(reviewed.select("corr_id").distinct().withColumn("reviewed", F.lit(True)), "corr_id", "left")
    clean = (F.col("result") == "success") & (F.coalesce("n_findings", F.lit(0)) > 0)
    return out.withColumn("reviewed", F.coalesce("reviewed", F.lit(False))).withColumn("n_findings", F.coalesce("n_findings", F.lit(0)).cast("long")).withColumn("result", F.when(clean, "ai_suspected").otherwise(F.col("result")))
