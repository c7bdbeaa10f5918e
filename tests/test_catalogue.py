"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pytest

from terrafuse.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(rows, columns):
    def one(v):
        if isinstance(v, float | np.floating):
            return None if v != v else repr(round(float(v), 9) + 0.0)
        if isinstance(v, list | np.ndarray):
            return str([one(x) for x in v])
        return None if v is None else str(v)

    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(one(r[i])) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got == canonical(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0
