"""Every query of the retrieval plans against its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tessera.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    r = duck.execute(oracles.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(cell(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall())
    assert sorted(tuple(cell(row[c]) for c in sorted(names)) for row in df.collect()) == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.QUERIES) - set(oracles.SQL) == {"lambdamart_topk"}
