"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """doc_id, text (binary), label of at most per_class training documents of each label.

    Rows are taken in the order of a hash of doc_id, so the sample does not depend on the data's layout.
    `train` is a condition over doc_id. An id labelled twice takes its smallest label; null labels are left out.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).where(train)
    picks = [one.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # At most 2 * per_class rows of two numbers: small enough to broadcast whatever the table.
    ids = F.broadcast(picks[0].union(picks[1]))
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(ids, "doc_id")
