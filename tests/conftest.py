import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pitchloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "4", 4)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return SF


@pytest.fixture(scope="session")
def same():
    """Spark rows of a query against its oracle, value by value; both round what they compute."""
    import duckdb

    def rows(records):
        fix = lambda v: v + 0.0 if isinstance(v, float) and v == v else (None if isinstance(v, float) else v)
        return sorted((tuple(fix(x) for x in r) for r in records), key=repr)

    def check(spark, sf, query, sql):
        df = query(spark, sf)
        names = sorted(df.columns)
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for f in os.listdir(sf):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
        got = rows(tuple(r) for r in df.select(*names).collect())
        want = rows(con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a == b

    return check
