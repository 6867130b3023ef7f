"""Connected components of a link table, without bringing links or components to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Links a task joins up before it hands on its forest.
LOCAL_LINKS = 1_000_000


def _forest(links: dict) -> pa.RecordBatch:
    """Union-find over links collected in `links` as parent pointers; one (node, root) row per non-root."""

    def find(x):
        root = x
        while links[root] != root:
            root = links[root]
        while links[x] != root:
            links[x], x = root, links[x]
        return root

    rows = [(x, r) for x in links if (r := find(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _local_union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= LOCAL_LINKS:
            yield _forest(parent)
            parent.clear()
    if parent:
        yield _forest(parent)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): the smallest node it reaches.

    Each task first joins up its own links (union-find). Then, round by round, every node points at its
    smallest neighbour, pointers are followed to their ends, and links are redrawn between the ends.
    """
    edges = materialize(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_local_union, "a long, b long").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("top")), "up")
        while True:
            ends = up.select(F.col("node").alias("top"), F.col("top").alias("end"))
            step = materialize(up.join(ends, "top").select("node", F.col("end").alias("top"), (F.col("end") != F.col("top")).alias("moved")), "up")
            moved = step.where("moved").limit(1).count()
            discard(up)
            up = step.drop("moved")
            up._logloom_path = step._logloom_path
            if not moved:
                break
        if labels is None:
            labels = up
        else:
            over = up.select(F.col("node").alias("top"), F.col("top").alias("end"))
            labels = labels.join(over, "top", "left").select("node", F.coalesce("end", "top").alias("top"))
        ends_a, ends_b = (up.select(F.col("node").alias(x), F.col("top").alias(f"{x}2")) for x in ("a", "b"))
        redrawn = materialize(edges.join(ends_a, "a").join(ends_b, "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "links")
        discard(edges)
        edges = redrawn
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("top").alias("component"))
