"""Every query of the main library against its SQL in DuckDB, over whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from vicinal.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", [*QUERIES])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = duck.execute(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(c[0] for c in got.description)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in got.description], got.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "cell_count" in df.columns
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_feature_schemas_hold_whole_part(spark):
    before = {r[0] for r in spark.sql("show databases").collect()}
    QUERIES["list_feature_schemas"](spark, FOLDER).collect()
    (db,) = {r[0] for r in spark.sql("show databases").collect()} - before
    whole = spark.read.parquet(f"{FOLDER}/part.parquet").count()
    assert [spark.table(f"{db}.genes_{x}").count() for x in "abc"] == [whole] * 3
