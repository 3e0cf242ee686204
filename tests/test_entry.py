"""The driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from termloom.plans import registry

SMALL = "/root/testdata/sf0.001"


def same(x):
    if x is None or x != x:
        return None
    return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck():
    import os

    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_daily_terms(spark, duck):
    from termloom.operators.sampling import picked_places

    n = duck.execute("SELECT count(*) FROM part").fetchone()[0]
    got = {r["pick"]: r["slug"] for r in registry.queries()["daily_terms"](spark, SMALL).collect()}
    assert got == {i: f"part-{p}" for i, p in enumerate(picked_places(n, 5, "2026-8-15"))}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SMALL)
    want = duck.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    theirs = sorted(str([same(r[i]) for i in order]) for r in want.fetchall())
    ours = sorted(str([same(r[c]) for c in columns]) for r in got.collect())
    assert ours == theirs
