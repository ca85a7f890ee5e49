"""Every query of the catalogue against its SQL in DuckDB, value by value."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pointlake import catalog
from pointlake.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    pick = ", ".join(f'"{c}"' for c in columns)
    want = sorted(map(str, duck.execute(f"SELECT {pick} FROM ({ORACLE_SQL[name]})").fetchall()))
    assert got == want and got


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def formatted(spark, df):
    return spark.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_reach_the_scan(spark):
    plan = formatted(spark, catalog.box_query(spark, SF))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "LessThanOrEqual(l_discount,0.06)" in plan and "Exchange" not in plan
    scan = [x for x in formatted(spark, catalog.projection(spark, SF)).splitlines() if "ReadSchema" in x]
    assert scan and not any("l_shipdate" in x for x in scan)
