"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tripspark import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    cut = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted([tuple(cut(r[c]) for c in names) for r in table.to_pylist()], key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DATA).toArrow(), duck.execute(plans.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
