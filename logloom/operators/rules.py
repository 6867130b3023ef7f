"""Validation rules of single applications: functions that give deltas by transaction, folded into the verdict once.

A rule takes a `Case` and returns (corr_id, delta): a text for each violation. Rules of all applications are unioned, so a transaction is
judged in one aggregation, however many rules there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.protocols import CALL_APP, XML_APP, Protocol
from logloom.operators import validation
from logloom.operators.stored import union_all


@dataclass
class Case:
    """What rules read: validated transactions of one application (with a ts_ column per phase), its events, and outcomes that joined lines prove (corr_id, outcome)."""

    app: Protocol
    transactions: DataFrame
    events: DataFrame
    outcomes: DataFrame | None = None
    records: DataFrame | None = None


Rule = Callable[[Case], DataFrame]


def phases_in_order(case: Case) -> DataFrame:
    """A later phase whose first time is before an earlier one's."""
    bad = validation.order_violations(case.transactions, case.app)
    return bad.select("corr_id", F.concat(F.lit("out of order: "), "later", F.lit(" before "), "earlier").alias("delta"))


def one_followup_each(case: Case) -> DataFrame:
    """Several different messages for one phase."""
    many = validation.duplicate_followups(case.events, case.app)
    return many.select("corr_id", F.concat(F.lit("repeated: "), F.col("n").cast("string"), F.lit(" of "), "type").alias("delta"))


def outcome_by_joined_lines(case: Case) -> DataFrame:
    """A recorded status that the joined lines contradict."""
    return _contradicted(case.transactions, case.outcomes.withColumnRenamed("outcome", "_proven"), "joined lines say ")


def outcome_by_record(case: Case) -> DataFrame:
    """A recorded status that the system of record contradicts. records: corr_id, outcome (completed, failed or unknown)."""
    return _contradicted(case.transactions, case.records.select("corr_id", F.col("outcome").alias("_proven")), "the record says ")


def _contradicted(t: DataFrame, proven: DataFrame, said: str) -> DataFrame:
    bad = ((F.col("_proven") == "completed") & F.col("status").isin("failed", "error")) | ((F.col("_proven") == "failed") & (F.col("status") == "completed"))
    return t.join(proven, "corr_id").where(bad).select("corr_id", F.concat(F.lit(said), "_proven").alias("delta"))


#: Rules by application.
RULES: dict[str, tuple[Rule, ...]] = {XML_APP.id: (phases_in_order, one_followup_each), CALL_APP.id: (outcome_by_joined_lines,)}


def judge(cases: list[Case], rules: dict[str, tuple[Rule, ...]] = RULES) -> DataFrame:
    """Validated closed transactions of all cases with their rules' deltas (sorted) after the general ones, and the result that follows.

    Columns: corr_id, application, status, delta, result.
    """
    found = [rule(c).select(F.lit(c.app.id).alias("application"), "corr_id", "delta") for c in cases for rule in rules.get(c.app.id, ())]
    every = union_all([c.transactions.select("application", "corr_id", "status", "active", F.col("delta").alias("_general"), F.col("result").alias("_result")) for c in cases])
    if not found:
        return every.select("corr_id", "application", "status", F.col("_general").alias("delta"), F.col("_result").alias("result"))
    # At most a few texts per rule and transaction.
    folded = union_all(found).groupBy("application", "corr_id").agg(F.array_sort(F.collect_list("delta")).alias("_own"))
    own = F.when(~F.col("active"), F.col("_own"))
    joined = every.join(folded, ["application", "corr_id"], "left").withColumn("_own", F.coalesce(own, F.array().cast("array<string>")))
    delta = F.concat("_general", "_own")
    return joined.select("corr_id", "application", "status", delta.alias("delta"), F.when(F.size("_own") > 0, "failure").otherwise(F.col("_result")).alias("result"))
