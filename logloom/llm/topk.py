"""Exact top-k search over embeddings by no-random-access aggregation (NRA).

Component x counts as floor(1024 * x); the score is the integer inner product. Candidates are dealt into
shards by a hash of their row, queries into blocks; each (shard, block) is one group. A shard keeps every
component as a list sorted by value. For a block of queries the lists are read sequentially from the end
that the sign of the query's component prefers, deeper from round to round. What has been read gives each
candidate a lower bound (unread components count as the list's last value) and an upper bound (unread
components count as the value at the reading depth). A query stops once few candidates' upper bounds reach
the k-th best lower bound: the outsiders cannot qualify, and the final scores of the rest are resolved.
The shards' lists of k are merged by a ranking per query. Exact for any data; only the depth depends on it.

Scores beyond 64 bits count as the largest or smallest such number.

Defined results: vectors null, empty or holding null or non-finite components take no part, as queries or
candidates; a shorter vector counts as padded with zeros; rows that repeat a vec_id are rows of their own (a
query excludes only its own row); rows with a null vec_id take no part, since they cannot be reported;
fewer than k candidates give fewer rows; ties go to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read

SHARD, BLOCK = 4096, 512
#: Reading ends when this many candidates are left for a query; their scores are resolved exactly.
LEFT = 64


def _stack(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of x with all of q."""
    largest = [max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0)))) for v in (x, q)]
    most = x.shape[1] * largest[0] * largest[1]  # no sum on the way is beyond
    if most < 1 << 53:
        return (x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return x @ q.T
    return np.clip(x.astype(object) @ q.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def nra(x: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query, positions in x that hold its k best (with all that tie or might), by NRA."""
    n, nq = len(x), len(q)
    if n <= LEFT:
        return [np.arange(n)] * nq
    values = x.astype(np.float64)
    lists = np.sort(values, axis=0)  # ascending; read from the top for positive, the bottom for negative components
    out: list = [None] * nq
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    worst = (lists[0] * up + lists[-1] * down).sum(axis=1)
    live, depth, left = np.arange(nq), max(32, n // 32), np.arange(n)  # queries, reading depth, candidates that may still qualify somewhere
    while len(live):
        depth = min(depth, n)
        high, low = lists[n - depth], lists[depth - 1]  # the values at the reading depth
        own = values[left]
        read_high, read_low = own >= high, own <= low
        p, m = up[live], down[live]
        # lower: read values, else the list's last; kept as an excess over the all-last sum
        lower = (np.where(read_high, own - lists[0], 0.0) @ p.T + np.where(read_low, own - lists[-1], 0.0) @ m.T).T + worst[live, None]
        upper = (np.where(read_high, own, high) @ p.T + np.where(read_low, own, low) @ m.T).T
        slack = 1e-9 * (1.0 + np.abs(upper).max(axis=1))
        bar = np.partition(lower, len(left) - k, axis=1)[:, len(left) - k] if len(left) > k else lower.min(axis=1)
        may = upper >= (bar - slack)[:, None]
        done = (may.sum(axis=1) <= max(LEFT, 2 * k)) | (depth == n)
        for i in np.flatnonzero(done):
            out[live[i]] = left[may[i]]
        # Outsiders to all open queries are read no further; the k best lower bounds are never among them.
        live, depth, left = live[~done], depth * 2, left[may[~done].any(axis=0)]
    return out


def _search(k: int):
    schema = "query_row long, query_id long, vec_id long, score long"

    def run(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(cands) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_row", "query_id", "vec_id", "score")})
        width = max(cands["v"].map(len).max(), queries["v"].map(len).max())
        x, q = _stack(cands["v"], width), _stack(queries["v"], width)
        ids, rows = cands["vec_id"].to_numpy(), cands["row"].to_numpy()
        parts = []
        for i, (row, qid, may) in enumerate(zip(queries["row"], queries["vec_id"], nra(x, q, k + 1), strict=True)):  # one more: the query itself
            may = may[rows[may] != row]
            score = _products(x[may], q[i : i + 1])[:, 0]
            best = np.lexsort((ids[may], -score))[:k]
            parts.append(pd.DataFrame({"query_row": row, "query_id": qid, "vec_id": ids[may][best], "score": score[best]}))
        return pd.concat(parts)

    return run, schema


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors, queries: row, vec_id, v (array<long>). Per query row its k best others: query_id, rank, vec_id, score."""
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((vectors, SHARD), (queries, BLOCK)))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = vectors.select(deal(shards).alias("shard"), every(blocks).alias("block"), "row", "vec_id", "v")
    q = queries.select(every(shards).alias("shard"), deal(blocks).alias("block"), "row", "vec_id", "v")
    run, schema = _search(k)
    found = c.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(df: DataFrame) -> DataFrame:
    """row, vec_id, v: the usable vectors as integers."""
    d = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(d, lambda x: F.floor(x * 1024.0).cast("long"))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "vec_id", scaled.alias("v"))


def op1_topk(spark, sf_dir: str) -> DataFrame:
    vectors = materialize(integer_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 10
"""
