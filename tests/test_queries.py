"""Every registered query against its SQL, or at least run, over the smallest tables."""

import math

import duckdb
import pytest

from quillspark.queries import ORACLE_SQL, QUERIES
from quillspark.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.01"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda x: round(x, 6) if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(clean(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    out = duck.execute(ORACLE_SQL[name])
    want = rows([d[0] for d in out.description], out.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in out.description)
    assert got == want
