"""Every catalogue query against its DuckDB oracle on sf0.001 (the driver's gate runs sf0.01)."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

from conftest import SF001

import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(v) if abs(v) < 2 ** 53 else v
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF001, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


NAMES = sorted(E.oracle_sql())


def test_every_query_has_a_builder():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    cols, rows = df.columns, df.collect()
    cur = con.execute(E.oracle_sql()[name])
    ocols, orows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(c.lower() for c in cols) == sorted(c.lower() for c in ocols)
    si = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    oi = sorted(range(len(ocols)), key=lambda i: ocols[i].lower())
    got = sorted((tuple(_norm(r[i]) for i in si) for r in rows), key=_key)
    want = sorted((tuple(_norm(r[i]) for i in oi) for r in orows), key=_key)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "SKEY" in df.columns


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF001).count() >= 0
