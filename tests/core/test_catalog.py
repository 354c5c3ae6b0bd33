"""Every registered query against its SQL, and sound schemas for those without."""

import datetime
import decimal
import os

import duckdb
import pytest

from parley.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str, bytes, datetime.date)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.8g}"
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    return [plain(x) for x in v]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in catalog.oracle_sql():
        assert rows
        return
    want = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in rows)
    at = [names.index(c) for c in sorted(names)]
    # whole floats and integers read alike
    tidy = lambda xs: [x.replace(".0'", "'") for x in xs]
    assert tidy(got) == tidy(sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall()))


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
