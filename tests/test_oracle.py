"""Registered queries against their SQL on the smallest tables; all but those of the training-data folder, which has its own tests."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def coarse(v):
    """What rows are sorted by: numbers at four digits, behind all else."""
    return tuple(coarse(x) for x in v) if isinstance(v, tuple) else round(v, 4) if isinstance(v, float) else v


def place(row):
    return repr([v for v in row if not isinstance(v, float)]), repr(coarse(row))


def same(a, b):
    """Equal, numbers to six digits: a tie at the sixth one may be rounded either way."""
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1.5e-6 + 1e-9 * abs(b)
    return a == b


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == columns
    places = [found.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in places) for r in cursor.fetchall()), key=place)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=place)
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want, strict=True) if not same(g, w)] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
