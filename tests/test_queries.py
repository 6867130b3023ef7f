"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from logloom.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(df):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return None
        if isinstance(v, str):
            return v
        return round(float(v), 5) + 0.0

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not Path(DATA).exists(), reason="tables not given")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="tables not given")
def test_related_logs_of_all_orders(spark):
    """Open orders' lines count as those of settled ones do."""
    got = {r.corr_id for r in QUERIES["related_logs"](spark, DATA).collect()}
    assert got == {f"m{r.o_orderkey}" for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()}
