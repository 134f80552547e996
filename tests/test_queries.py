"""Each registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from chronofold.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({queries.SQL[name]})").fetchall()
    assert normal(df.select(columns).collect()) == normal(want)


def test_every_query_has_sql():
    assert set(queries.SQL) == set(queries.QUERIES)


def test_filters_reach_the_scan(spark):
    plan = queries.read_all_page(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "TakeOrderedAndProject" in plan
