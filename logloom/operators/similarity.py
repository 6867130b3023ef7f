"""Nearest rows by cosine distance, and the recency fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(rows: DataFrame, vector: str, query: list[float] | None, k: int, key: str, recency: Column | None = None) -> DataFrame:
    """The k rows closest to the query (ties by key); newest rows if there is no query. Null vectors take no part."""
    if query is None:
        return rows.orderBy(recency.desc_nulls_last() if recency is not None else F.col(key).desc(), F.col(key)).limit(k)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.where(F.col(vector).isNotNull()).withColumn("distance", cosine_distance(F.col(vector), q)).orderBy(F.col("distance").asc_nulls_last(), F.col(key)).limit(k)
