"""Mixing sources to target weights by weighted fair queueing.

Sources are ordered by code point (null last) and weigh 5, 2, 1, repeating. They share `budget` times all
words; a target stops at `repeats` times its source's size and the excess is shared again by weight until
none is above. Within its source, each document has a place in a shuffled order; every pass over the source
appends its documents again. A word's virtual finish time is the source's words up to it divided by the
source's target. The line of all sources' words, sorted by finish time, is cut at the total budget.

Words are sorted only where the cut may fall. Documents range-sorted by the time they begin tell until when all
that has begun fits into the budget; documents range-sorted by finish time tell when the budget is exceeded at
the latest. What is finished before that span is taken whole; the words that finish within it are sorted one by one.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own;
repeated rows are documents of their own, equal in all that orders them, so either may be the cut one and the
returned rows are the same; a source without words has target 0; an empty table gives an empty result.
Reruns agree: the shuffle is a hash of doc_id and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, read, running_total, words

WEIGHTS = (5.0, 2.0, 1.0)
#: Above this many sources their table is joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row per source.

    The share per weight only rises from one round to the next, as saturated sources drop out; each round is
    one aggregation over the table of sources and the driver keeps two numbers.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = materialize(running_total(per, order, F.lit(1), "_rank", "sources"), "ranked")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    # materialized: each round reads the small table again
    table = materialize(ranked.withColumn("_weight", weight).drop("_rank"), "weights")
    discard(ranked)
    limit = F.col("source_size") * F.lit(repeats)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:
        over = F.col("_weight") * F.lit(share) >= limit
        row = table.agg(F.sum(F.when(over, limit)).alias("used"), F.sum(F.when(~over, F.col("_weight"))).alias("w"), F.count_if(over).alias("n")).first()
        if row["n"] == full or not row["w"]:
            break
        full, share = row["n"], (budget * total - (row["used"] or 0.0)) / row["w"]
    done = F.col("_weight") * F.lit(share) >= limit
    open_left = bool(row["w"])
    target = F.when(done, limit).otherwise(F.col("_weight") * F.lit(share)) if open_left else limit
    return table.withColumn("target", target.cast("double")).drop("_weight")


def _with_sources(df: DataFrame, targets: DataFrame) -> DataFrame:
    keyed = targets.select(F.col("source").alias("_s"), "source_size", "target")
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        keyed = F.broadcast(keyed)
    return df.join(keyed, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def timeline(sizes: DataFrame, targets: DataFrame, repeats: int = 2, seed: int = 7) -> DataFrame:
    """One row per document and pass: the source's words before it (`begin`), and its virtual times `start` and `finish`.

    sizes needs doc_id, source, size and may carry more columns. Documents without words are left out.
    """
    shuffled = sizes.where("size > 0").withColumn("_key", F.xxhash64("doc_id", "size", F.lit(seed)))
    by_source = [F.col("source").isNull(), F.col("source"), F.col("_key"), F.col("doc_id"), F.col("size")]
    # One global order with the source first: a hot source spreads over many range partitions. What comes
    # before a document in its own source is the global total less the total where its source begins.
    placed = running_total(shuffled, by_source, F.col("size"), "_global", "by-source")
    starts_of = running_total(targets.select("source", "source_size"), by_source[:2], F.col("source_size"), "_start", "starts")
    starts = targets.join(starts_of.select(F.col("source").alias("_s2"), "_start"), F.col("source").eqNullSafe(F.col("_s2"))).drop("_s2")
    keyed = starts.select(F.col("source").alias("_s"), "source_size", "target", "_start")
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        keyed = F.broadcast(keyed)
    docs = placed.join(keyed, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    packets = docs.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    begin = F.col("pass") * F.col("source_size") + F.col("_global") - F.col("_start")
    timed = packets.withColumn("begin", begin.cast("long")).drop("_global", "_start")
    return timed.withColumn("start", F.col("begin") / F.col("target")).withColumn("finish", (F.col("begin") + F.col("size")) / F.col("target"))


def _exceeded(line: DataFrame, time: str, total: int) -> float:
    """The time of the first document, in the order of time, up to which sizes add up to more than total; infinity if there is none."""
    lined = running_total(line.select(time, "size"), [F.col(time), F.col("size")], F.col("size"), "_before", f"by-{time}")
    found = lined.where(F.col("_before") + F.col("size") > total).agg(F.min(time)).first()[0]
    return float("inf") if found is None else found


def truncate(line: DataFrame, total: int) -> DataFrame:
    """The first `total` words of a timeline in the order of their finish times: rows of it with the words `sent` of each, if any.

    line should be materialized, and its documents told apart by _row and pass.
    """
    whole_until, none_after = _exceeded(line, "start", total), _exceeded(line, "finish", total)
    if none_after == float("inf"):
        return line.withColumn("sent", F.col("size"))
    # Words certain to be sent, and the last that may be; a word more or less on either side makes up for rounding.
    at = lambda time: F.floor(F.lit(time) * F.col("target") - F.col("begin"))
    within = lambda n: F.greatest(F.lit(0), F.least(F.col("size"), n)).cast("long")
    sure = F.when(F.col("finish") < whole_until, F.col("size")).otherwise(within(at(min(whole_until, none_after)) - 1))
    spans = line.withColumn("_sure", sure).withColumn("_last", F.greatest("_sure", within(at(none_after) + 1)))
    left = total - int(spans.agg(F.sum("_sure")).first()[0] or 0)
    open_words = spans.where(F.col("_last") > F.col("_sure")).select("_row", "pass", "source", "_key", "doc_id", "begin", "target", F.explode(F.sequence(F.col("_sure") + 1, F.col("_last"))).alias("_word"))
    open_words = open_words.withColumn("_time", (F.col("begin") + F.col("_word")) / F.col("target"))
    order = [F.col("_time"), F.col("source").isNull(), F.col("source"), F.col("_key"), F.col("doc_id"), F.col("pass"), F.col("_row"), F.col("_word")]
    sent = running_total(open_words, order, F.lit(1), "_before", "words").where(F.col("_before") < left)
    more = sent.groupBy("_row", "pass").agg(F.count(F.lit(1)).alias("_more"))
    out = spans.join(more, ["_row", "pass"], "left").withColumn("sent", F.col("_sure") + F.coalesce("_more", F.lit(0)))
    return out.where(F.col("sent") > 0).drop("_sure", "_last", "_more")


def mix(sizes: DataFrame, targets: DataFrame, budget: float = 1.5, repeats: int = 2) -> DataFrame:
    """What the mix takes: _row, size, pass, finish, and the words `sent` of each document and pass."""
    total = int(sizes.agg(F.sum("size")).first()[0] or 0)
    line = materialize(timeline(sizes, targets, repeats), "line")
    return truncate(line, int(budget * total)).select("_row", "size", "pass", "finish", "sent")


def mix_documents(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, budget: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    sizes = materialize(docs.select("doc_id", "source", (F.size(words(F.col("text"))) if size is None else size).cast("long").alias("size"), F.monotonically_increasing_id().alias("_row")), "sizes")
    targets = materialize(source_targets(sizes, weights, budget, float(repeats)), "targets")
    taken = mix(sizes, targets, budget, repeats).groupBy("_row").agg(F.sum("sent").alias("taken"))
    out = _with_sources(sizes, targets).join(taken, "_row", "left")
    return out.select("_row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself: a row per document and pass, columns of docs; a cut document keeps its first words.

    Rows that repeat a doc_id, or have none, are documents of their own; a null text has no words and is never taken; columns of docs may
    have any names.
    """
    rows = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "mix-rows")
    own = words(F.col("_doc")["text"])
    sizes = materialize(rows.select("_row", F.col("_doc")["doc_id"].alias("doc_id"), F.col("_doc")["source"].alias("source"), F.size(own).cast("long").alias("size")), "sizes")
    targets = materialize(source_targets(sizes), "targets")
    sent = mix(sizes, targets).select("_row", "size", "sent")
    first_words = F.array_join(F.slice(own, F.lit(1), F.col("sent").cast("int")), " ")
    text = F.when(F.col("sent") < F.col("size"), first_words).otherwise(F.col("_doc")["text"])
    return rows.join(sent, "_row").select(*[text.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix_documents(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
