"""Every query with SQL gives the same rows as DuckDB over the small tables."""

import os

import duckdb
import pytest

from millrace.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = [tuple(round(float(r[i]), 6) if isinstance(r[i], (float, int)) and not isinstance(r[i], bool) else r[i] for i in order) for r in rows]
    return sorted(names), sorted(clean, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    expected = rows_of([c[0] for c in result.description], result.fetchall())
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
