"""Every query of the lens and of the harder cases against its SQL."""

import os

import duckdb
import pytest
from lodestone.plans import cases, lens, shown

from test_catalogue import _plain

DATA = "/root/testdata/sf0.01"
NAMES = sorted(n for n in lens.ORACLE_SQL if not (n[0] == "q" and n[1].isdigit()) and lens.QUERIES[n].__module__ in (lens.__name__, cases.__name__, shown.__name__))


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    got = lens.QUERIES[name](spark, DATA)
    want = db.execute(lens.ORACLE_SQL[name])
    columns = sorted(got.columns)
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted([_plain(r[c]) for c in columns] for r in got.collect()) == sorted([_plain(r[i]) for i in at] for r in want.fetchall())
