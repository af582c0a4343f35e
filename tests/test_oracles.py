"""Each registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from lumenlake.plans import registry as R

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def same(v):
    return round(v, 6) if isinstance(v, float) else round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_query(spark, db, name):
    out = R.QUERIES[name](spark, D)
    names = sorted(out.columns)
    got = sorted(repr([same(r[c]) for c in names]) for r in out.collect())
    if name in R.ORACLES:
        want = db.sql(R.ORACLES[name])
        cols = want.columns
        assert sorted(cols) == names
        assert got == sorted(repr([same(dict(zip(cols, r))[c]) for c in names]) for r in want.fetchall())
