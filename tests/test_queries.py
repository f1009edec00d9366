from pathlib import Path

import duckdb
import pytest

from cloakspan import queries as Q

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        own.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return own


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    found = Q.queries()[name](spark, str(TABLES)).toPandas()
    if name in Q.oracle_sql():
        expected = con.sql(Q.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
    else:
        assert len(found)
