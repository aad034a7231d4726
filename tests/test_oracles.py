"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from paperloom import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(tuple(str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), db.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(want.columns)) == plain(want, sorted(want.columns))
