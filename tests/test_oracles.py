"""Every query with SQL beside it gives DuckDB's rows; the others give rows."""

import duckdb
import pytest

from palaver.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return None if v is None else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in ORACLES:
        q = duck.execute(ORACLES[name])
        names = [d[0] for d in q.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in q.fetchall()), key=repr)
        assert got == want
