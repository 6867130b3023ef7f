"""Quality rules with risk-controlled cutoffs (native: DataFrame functions only).

Every document gets exact counts; rules compare ratios of them with cutoffs per stratum (document length
class). A cutoff is taken from labelled good documents: it is allowed only if the exact (Clopper-Pearson)
upper bound of its false-rejection rate is at most `risk`. Within a rule and stratum the cutoffs are tested
from the loosest to the strictest (fixed-sequence testing needs no further correction); over rules and
strata the level is divided (Bonferroni), so with probability 1 - delta all cutoffs keep the promise.

Defined results: null or empty text has no words and fails the base rule; without labels (or with too few
for any guarantee) every rule is off and only the base rule decides; a document labelled more than once
counts as good only if all its labels are; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, HAS_WORD, all_of, materialize, read

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Upper word counts of the length classes; the last class is open.
STRATA = (50, 200, 1000)
#: Cutoffs tested for every rule, loosest first.
GRID = (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02)


@dataclass(frozen=True)
class Risk:
    """At most `risk` of the good documents of a stratum rejected by a rule, all at once with probability 1 - delta."""

    risk: float = 0.01
    delta: float = 0.1
    #: Rejected good documents that outweigh one rejected bad one, in choosing among allowed cutoffs.
    price: float = 3.0


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


#: Rule name -> ratio over the measured columns. A document is rejected if a ratio exceeds its cutoff.
RULES = {
    "symbols": lambda: _ratio(F.col("n_symbols"), F.col("word_chars")),
    "upper": lambda: _ratio(F.col("n_upper"), F.col("word_chars")),
    "bangs": lambda: _ratio(F.col("n_bangs"), F.col("word_chars")),
    "dup_lines": lambda: _ratio(F.col("n_dup_lines"), F.col("n_lines")),
    "repeats": lambda: _ratio(F.col("n_repeat_words"), F.col("n_words")),
}


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts. Columns of docs with the same names as counts are replaced."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = (
        docs.withColumn("_body", body)
        .withColumn("_words", F.array_remove(F.split("_body", BLANKS), ""))
        .withColumn("_lines", F.filter(F.split("_body", "\n"), lambda x: x.rlike(HAS_WORD)))
    )
    hashed = base.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1))
    windows = hashed.withColumn(
        "_windows",
        F.when(F.size("_hashes") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))).otherwise(F.array().cast("array<long>")),
    )
    # Sorted only where some window occurs twice; equal windows are then neighbours.
    ordered = windows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ),
    )
    same = lambda e, i: F.coalesce(F.get("_sorted", i - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get("_sorted", i + 1)["x"] == e["x"], F.lit(False))
    repeated = ordered.withColumn("_at", F.array_sort(F.transform(F.filter("_sorted", same), lambda e: e["i"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("covered"))
    step = lambda a, p: F.struct(p.alias("last"), (a["covered"] + F.least(F.lit(WINDOW), p - a["last"])).alias("covered"))
    covered = F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.aggregate("_at", start, step)["covered"])
    return (
        repeated.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", _count(F.col("_body"), SYMBOLS).cast("long"))
        .withColumn("n_upper", F.length(F.regexp_replace("_body", r"[^\p{Lu}]+", "")).cast("long"))
        .withColumn("n_bangs", _count(F.col("_body"), "!").cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", covered.cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .drop("_body", "_words", "_lines", "_hashes", "_windows", "_sorted", "_at")
    )


def stratum() -> Column:
    expr = F.lit(len(STRATA))
    for k in reversed(range(len(STRATA))):
        expr = F.when(F.col("n_words") < STRATA[k], F.lit(k)).otherwise(expr)
    return expr


def binomial_cdf_log(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k), X binomial(n, p), by the ratio of neighbouring terms; exact up to rounding."""
    import math

    odds = math.log(p / (1 - p))
    first = n.cast("double") * math.log1p(-p)
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (F.greatest(a["total"], term) + F.log1p(F.exp(-F.abs(a["total"] - term)))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, start, add)["total"]


def calibrate(measured: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[tuple[int, str], float]:
    """Cutoff by (stratum, rule); absent where no cutoff holds the promise. At most 4 x 5 numbers reach the driver."""
    import math

    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_good")).where(F.col("_good").isNotNull())
    held = measured.where(~F.col("base_failed")).join(good, "doc_id").withColumn("_stratum", stratum())
    fine = F.col("_good") == 1
    counts = [F.count_if(side & (RULES[r]() > c)).alias(f"{r}__{k}__{name}") for r in RULES for k, c in enumerate(GRID) for name, side in (("good", fine), ("bad", ~fine))]
    per = held.groupBy("_stratum").agg(F.count_if(fine).alias("n"), *counts)
    tests = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}__{k}__good").alias("k"), F.col(f"{r}__{k}__bad").alias("bad")) for r in RULES for k, c in enumerate(GRID)]))
    level = math.log(risk.delta / (len(RULES) * (len(STRATA) + 1)))
    rows = (
        per.select("_stratum", "n", tests.alias("t")).select("_stratum", "n", "t.*")
        .where(F.col("k") <= F.col("n") * risk.risk)
        .where(binomial_cdf_log(F.col("k"), F.col("n"), risk.risk) <= level)
        # All these keep the promise; of them the one that tells bad from good documents best, the loosest on ties.
        .groupBy("_stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("bad") - risk.price * F.col("k"), "cutoff")).alias("cutoff"))
    )
    return {(r["_stratum"], r["rule"]): r["cutoff"] for r in rows.collect()}


def judge(measured: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """Add `kept`: the base rule and all cutoffs of the document's stratum hold."""
    at = stratum()
    fine = [~((at == s) & (RULES[r]() > c)) for (s, r), c in sorted(cutoffs.items())]
    return measured.withColumn("kept", ~F.col("base_failed") & all_of(fine))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """docs without the text, with counts, base_failed and kept. Texts are read once."""
    measured = materialize(measure(docs).drop("text"), "rules")
    return judge(measured, calibrate(measured, labels, risk))


def filter_documents(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns."""
    # Written out with its counts first: a filter on `kept` must not be pushed below the counting.
    own = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    measured = materialize(measure(own).drop("text"), "rules")
    return judge(measured, calibrate(measured, labels, risk)).where("kept").select("_row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = quality_rules(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
