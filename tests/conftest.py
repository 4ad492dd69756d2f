"""One local session for all tests, and the comparison with SQL."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from siltstone.session import local, ship

    session = local(os.environ.get("TEST_CPUS", "8"), name="tests")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def database():
    con = duckdb.connect()
    for f in sorted(os.listdir(SMALL)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    return con


@pytest.fixture(scope="session")
def same_as_sql(spark, database):
    """Holds a query's rows against those of its SQL."""

    def check(query, sql: str) -> None:
        df = query(spark, SMALL)
        rows = sorted(repr(tuple(r)) for r in df.collect())
        got = database.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in df.columns]
        assert rows == sorted(repr(tuple(r[i] for i in order)) for r in got.fetchall())

    return check
