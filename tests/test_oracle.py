"""Every query that has SQL beside it, against DuckDB on the same tables; the others run and have rows."""

import datetime
import decimal
import os

import duckdb
import pytest

from emberline import registry
from emberline.plans.catalog import TABLES

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, con, name):
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = table(names, cur.fetchall())
    df = registry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert df.columns and df.collect()
