"""Every query of the repository catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.plans import lens, repository  # noqa: F401

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in lens.QUERIES if n[0] == "q" and n[1].isdigit())


def _plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def test_the_catalogue_is_whole():
    # q14, the previous result, is j14.
    have = {int(n[1:].split("_")[0]) for n in NAMES} | {14}
    assert have == set(range(1, 39))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    got = lens.QUERIES[name](spark, DATA)
    want = db.execute(lens.ORACLE_SQL[name])
    columns = sorted(got.columns)
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted([_plain(r[c]) for c in columns] for r in got.collect()) == sorted([_plain(r[i]) for i in at] for r in want.fetchall())
