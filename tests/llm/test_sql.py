"""The queries that have SQL give the rows of DuckDB, over the small tables and over planted copies of vectors."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace.llm import rp_forest
from millrace.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def in_order(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    clean = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows]
    return sorted(names), sorted(clean, key=repr)


def in_duckdb(con, sql):
    found = con.execute(sql)
    return in_order([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    found = QUERIES[name](spark, FOLDER)
    assert in_order(found.columns, [tuple(r) for r in found.collect()]) == in_duckdb(con, ORACLES[name])


def test_forest_equals_sql_on_planted_copies(spark):
    """The small tables hold no vectors as near as that."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    near = [base[i % 12] + rng.normal(scale=s, size=24) for s in (0.0, 0.1, 0.2, 0.3, 0.4) for i in range(24)]
    vectors = [[float(x) for x in v] for v in [*base, *near]] + [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24]
    rows = [(i, v, None if i % 17 == 16 else i % 2) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r) for r in rows])
    found = rp_forest.near_duplicates(table)
    got = in_order(found.columns, [tuple(r) for r in found.collect()])
    assert got == in_duckdb(con, ORACLES["op3_rp_forest"])
    assert pd.DataFrame(got[1], columns=got[0])["n_links"].sum() > 100
