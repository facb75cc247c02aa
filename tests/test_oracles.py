"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from lodestone.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):  # noqa: ANN001, ANN201
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):  # noqa: ANN001, ANN201
    return round(x, 8) if isinstance(x, float) else x.isoformat() if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, small, duck, name):  # noqa: ANN001
    df = catalogue.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


#: Queries without SQL, with the rows that they give at this size.
ROWS = {"vec_index_topk": 250}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_runs(spark, small, name):  # noqa: ANN001
    assert catalogue.queries()[name](spark, small).count() == ROWS[name]
