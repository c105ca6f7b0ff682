"""Every catalog query against its DuckDB oracle (the driver's gate), at sf0.001."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from driftlens.plans import catalog
from driftlens.plans.oracle_sql import ORACLE
from driftlens.sources.tables import TABLES
from tests.conftest import SF_SMALL

QUERIES = catalog.QUERIES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return int(v)
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    # SQL has no xxhash64 for hashed words; tests/test_epochs.py holds them against numpy
    assert set(QUERIES) == set(ORACLE) | {"epoch_texts"}


def compare(df, duck, sql):
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, key):
    compare(QUERIES[key](spark, SF_SMALL), duck, ORACLE[key])


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["dataset", "label_id", "support", "accuracy"]
    assert df.count() > 0
