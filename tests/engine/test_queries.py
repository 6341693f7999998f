"""Every query of the engine against its SQL over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from tidemark import plans

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_and_sql_agree(spark, db, name):
    df = plans.QUERIES[name](spark, FOLDER)
    relation = db.sql(plans.ORACLE[name])
    assert sorted(df.columns) == sorted(relation.columns)
    columns = sorted(df.columns)
    got = [tuple(value(r[c]) for c in columns) for r in df.collect()]
    places = [relation.columns.index(c) for c in columns]
    want = [tuple(value(r[k]) for k in places) for r in relation.fetchall()]
    key = lambda r: [(v is not None, str(type(v)), v if v is not None else 0) for v in r]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_other_queries_have_rows(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
