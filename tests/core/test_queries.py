"""Every query against its SQL, on real tables."""

import math
import os

import duckdb
import pytest

from lineweave.plans import registry

DIR = os.environ.get("QUERY_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    found = registry.queries()[name](spark, DIR)
    names = sorted(found.columns)
    assert len(set(names)) == len(names)
    rows = [tuple(plain(r[n]) for n in names) for r in found.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    result = con.execute(sql)
    have = [x[0] for x in result.description]
    assert sorted(have) == names
    order = [have.index(n) for n in names]
    want = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    assert want, "an empty result shows nothing"
    assert sorted(rows, key=repr) == sorted(want, key=repr)
