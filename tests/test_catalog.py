"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from martmend import catalog

SF = "/root/testdata/sf0.001"
NAMES = "documents embeddings pages benchmark labels conversations region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    out = duck.execute(catalog.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(out.description)}
    assert sorted(at) == cols
    want = sorted((tuple(plain(r[at[c]]) for c in cols) for r in out.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_flagship_counts(spark):
    assert {r.really_changed for r in catalog.flagship(spark, SF).collect()} == {True}
    assert catalog.flagship(spark, SF).count() == 7
